"""License scans in DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance along paths.

The units compared are the lines of a text and its paragraphs (lines joined). A unit's vector has a weight for each
of its terms, count times inverse frequency over the templates; stop words weigh nothing, terms that no template has
the most. Only units that share a lettered term with a template are split into terms: all others have cosine 0. Of
these only units go on whose terms can reach the threshold at all: s known and o other terms give a cosine of at most
s / sqrt(s * s + o), since no known term weighs more than an other one and counts are at least 1. A document's own license is the template nearest to any of its units, from ``LEAST`` on.

A document without one takes that of the licence file in its directory, else of the nearest ancestor directory that
has one. Directories are resolved once each, by joining their ancestors to the directories with licence files, and
documents are joined to their own directory only; the template tables are constants of this module, the one thing that
is broadcast by hand.

Defined results: a null text counts as empty and has no own license; a null path is in no directory and inherits
nothing; repeated rows are each reported; of equally near templates the first by name counts, of several licence files in a
directory the first by path, then by license. Columns other than doc_id, text and path are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import materialize

LEAST = 0.6
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: File names that license their directory, lower-cased and without ending.
LICENCE_FILES = ("license", "licence", "copying", "unlicense", "notice")
STOP_WORDS = frozenset("a an and any are as at be by for from in is it its not of on or shall that the this to under was will with you your".split())
BREAK = r"\n[\x20\x09-\x0D]*\n"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Notices as they stand in headers and licence files.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004"],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "GPL-2.0": ["Licensed under the GNU General Public License, version 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def _terms(text: str) -> Counter:
    return Counter(t for t in re.findall(TERM, text.lower()) if t not in STOP_WORDS)


def template_weights() -> tuple[list[tuple[str, int, str, float]], dict[str, float], float, list[str]]:
    """(license, template, term, unit weight) rows, the terms' inverse frequencies, that of other terms, and the lettered terms."""
    vectors = [(name, n, _terms(t)) for name in sorted(TEMPLATES) for n, t in enumerate(TEMPLATES[name])]
    df = Counter(t for _, _, v in vectors for t in v)
    idf = {t: round(math.log((1 + len(vectors)) / (1 + c)) + 1, 9) for t, c in df.items()}
    rows = []
    for name, n, v in vectors:
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in v.items()))
        rows += [(name, n, t, round(c * idf[t] / norm, 9)) for t, c in sorted(v.items())]
    return rows, idf, round(math.log(1 + len(vectors)) + 1, 9), sorted(t for t in idf if t.isalpha())


def _values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    cell = lambda x: f"'{x}'" if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else repr(x)
    return spark.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f" AS t({columns})")


def own_licenses(files: DataFrame) -> DataFrame:
    """(row, license, score) of the files (row, text) with a license of their own."""
    spark = files.sparkSession
    rows, idf, other, lettered = template_weights()
    words = F.array(*map(F.lit, lettered))
    text = F.coalesce("text", F.lit(""))
    likely = files.where(F.arrays_overlap(F.split(F.lower(text), "[^a-z]+"), words))
    paragraphs = F.transform(F.split(text, BREAK), lambda p: F.translate(p, "\n", " "))
    units = likely.select("row", F.explode(F.array_distinct(F.concat(F.split(text, "\n"), paragraphs))).alias("unit"))
    units = units.select("row", "unit", F.translate("unit", _UPPER, _LOWER).alias("low")).where(F.arrays_overlap(F.split("low", "[^a-z]+"), words))
    stop, known = F.array(*map(F.lit, sorted(STOP_WORDS))), F.array(*map(F.lit, sorted(idf)))
    terms = F.filter(F.regexp_extract_all("low", F.lit(TERM), F.lit(0)), lambda t: ~F.array_contains(stop, t))
    termed = units.select("row", F.xxhash64("unit").alias("unit"), F.length("unit").alias("size"), terms.alias("terms"))
    shared = F.size(F.filter("terms", lambda t: F.array_contains(known, t)))
    termed = termed.withColumn("shared", shared.cast("double")).where(F.col("shared") * F.col("shared") * (1 - LEAST**2) >= LEAST**2 * (F.size("terms") - F.col("shared")) - 1e-6)
    split = termed.select("row", "unit", "size", F.explode("terms").alias("term"))
    counted = split.groupBy("row", "unit", "size", "term").agg(F.count("*").alias("n"))
    weights = _values(spark, sorted(idf.items()), "t, idf")
    weighed = counted.join(F.broadcast(weights), F.col("term") == F.col("t"), "left").select("row", "unit", "size", "term", (F.col("n") * F.coalesce("idf", F.lit(other))).alias("w"))
    weighed = materialize(weighed, "license-terms")
    norms = weighed.groupBy("row", "unit", "size").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(_values(spark, rows, "license, template, t, tw")), F.col("term") == F.col("t")).groupBy("row", "unit", "size", "license", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    near = dots.join(norms, ["row", "unit", "size"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= LEAST)
    best = near.groupBy("row", "license").agg(F.max("score").alias("score"))
    return best.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select("row", "b.license", (-F.col("b.s")).alias("score"))


def scan(files: DataFrame) -> DataFrame:
    """doc_id, path, license, score, found ('own', 'inherited', 'none') and licence_dir of every file row (doc_id, path, text)."""
    parts = [F.isnull("doc_id"), F.col("doc_id").cast("long"), F.isnull("path"), F.col("path").cast("string"), F.col("text")]
    key = F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(*reversed(parts)).alias("b"))  # equal for equal rows only, however often it is computed
    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), "text", key.alias("row"))
    own = materialize(own_licenses(rows), "license-own")
    slash = F.length("path") - F.instr(F.reverse("path"), "/")
    folder = F.when(F.instr("path", "/") > 0, F.substring("path", F.lit(1), slash)).otherwise(F.lit(""))
    placed = rows.select("doc_id", "path", "row", F.when(F.col("path").isNotNull(), folder).alias("dir"), F.lower(F.element_at(F.split("path", "/"), -1)).alias("name"))
    found = placed.join(own, "row", "left").withColumn("own", F.col("license")).drop("license")
    base = F.regexp_extract("name", r"^([^.]*)", 1)
    licensing = found.where(F.col("own").isNotNull() & F.col("dir").isNotNull() & base.isin(*LICENCE_FILES))
    by_dir = materialize(licensing.groupBy("dir").agg(F.min(F.struct("path", "own")).alias("f")).select(F.col("dir").alias("licence_dir"), F.col("f.own").alias("inherited")), "license-dirs")
    dirs = placed.where("dir is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/")))).alias("at")).distinct()
    nearest = above.join(by_dir, F.col("at") == F.col("licence_dir")).groupBy("dir").agg(F.max_by(F.struct("licence_dir", "inherited"), F.length("licence_dir")).alias("near"))
    joined = found.join(nearest, "dir", "left")
    has_own, has_near = F.col("own").isNotNull(), F.col("near").isNotNull()
    return joined.select(
        "doc_id", "path", F.coalesce("own", F.col("near.inherited")).alias("license"), F.when(has_own, F.col("score")).alias("score"),
        F.when(has_own, "own").when(has_near, "inherited").otherwise("none").alias("found"), F.when(~has_own & has_near, F.col("near.licence_dir")).alias("licence_dir"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """The documents table, which has no paths, as a tree of files: directories of 100 within directories of 1000 of a source.

    The first document of each directory stands for its licence file.
    """
    k, c = F.expr("cast(floor(doc_id / 1000) as string)"), F.expr("cast(floor(doc_id / 100) as string)")
    path = F.when(F.col("doc_id") % 1000 == 0, F.concat("source", F.lit("/"), k, F.lit("/LICENSE"))).when(
        F.col("doc_id") % 100 == 0, F.concat("source", F.lit("/"), k, F.lit("/"), c, F.lit("/LICENSE"))
    )
    return docs.select("doc_id", F.coalesce(path, F.concat("source", F.lit("/"), k, F.lit("/"), c, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")


def oracle() -> str:
    """DuckDB SQL for ``scan(document_files(documents))``."""
    rows, idf, other, lettered = template_weights()
    cell = lambda x: f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else repr(x)
    values = lambda rs: ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rs)
    words = "[" + ", ".join(f"'{w}'" for w in lettered) + "]"
    stop = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
    names = ", ".join(f"'{w}'" for w in LICENCE_FILES)
    low = lambda c: f"translate({c}, '{_UPPER}', '{_LOWER}')"
    return f"""
WITH idf(t, idf) AS (VALUES {values(sorted(idf.items()))}), tw(license, template, t, tw) AS (VALUES {values(rows)}),
files AS (SELECT doc_id, coalesce(text, '') AS text, source || '/' || (doc_id // 1000) || CASE WHEN doc_id % 1000 = 0 THEN '/LICENSE'
  WHEN doc_id % 100 = 0 THEN '/' || (doc_id // 100) || '/LICENSE' ELSE '/' || (doc_id // 100) || '/' || doc_id || '.txt' END AS path FROM documents),
units AS (SELECT DISTINCT doc_id, unit FROM (SELECT doc_id, unnest(string_split(text, chr(10)) || list_transform(string_split_regex(text, '{BREAK}'), lambda p: replace(p, chr(10), ' '))) AS unit FROM files)),
likely AS (SELECT doc_id, unit, {low('unit')} AS low FROM units WHERE list_has_any(string_split_regex({low('unit')}, '[^a-z]+'), {words})),
terms AS (SELECT doc_id, unit, term, count(*) AS n FROM (SELECT doc_id, unit, unnest(regexp_extract_all(low, '{TERM}')) AS term FROM likely) WHERE term NOT IN ({stop}) GROUP BY ALL),
weighed AS (SELECT doc_id, unit, term, n * coalesce(idf, {other!r}::DOUBLE) AS w FROM terms LEFT JOIN idf ON term = t),
norms AS (SELECT doc_id, unit, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
dots AS (SELECT doc_id, unit, license, template, sum(w * tw) AS dot FROM weighed JOIN tw ON term = t GROUP BY ALL),
near AS (SELECT doc_id, license, max(round(dot / norm, 6)) AS score FROM dots JOIN norms USING (doc_id, unit) WHERE round(dot / norm, 6) >= {LEAST} GROUP BY ALL),
own AS (SELECT doc_id, license, score FROM near QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
placed AS (SELECT f.doc_id, path, regexp_extract(path, '^(.*)/', 1) AS dir, lower(regexp_extract(path, '([^/.]*)[^/]*$', 1)) AS name, license AS own, score FROM files f LEFT JOIN own USING (doc_id)),
by_dir AS (SELECT dir AS licence_dir, arg_min(own, path) AS inherited FROM placed WHERE own IS NOT NULL AND name IN ({names}) GROUP BY dir),
nearest AS (SELECT d.dir, arg_max(licence_dir, length(licence_dir)) AS licence_dir, arg_max(inherited, length(licence_dir)) AS inherited
  FROM (SELECT DISTINCT dir FROM placed) d JOIN by_dir b ON d.dir = b.licence_dir OR starts_with(d.dir, b.licence_dir || '/') GROUP BY d.dir)
SELECT doc_id, path, coalesce(own, inherited) AS license, score,
  CASE WHEN own IS NOT NULL THEN 'own' WHEN inherited IS NOT NULL THEN 'inherited' ELSE 'none' END AS found,
  CASE WHEN own IS NULL THEN licence_dir END AS licence_dir
FROM placed LEFT JOIN nearest USING (dir)"""
