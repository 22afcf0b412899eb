"""Queries over page contexts, contents areas, command rules, and over lines with planted marks that the tables lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.functions import text as T
from docloom.operators import chapters, context as C, items as I, nodes, toc
from docloom.plans.documents import WS_SQL, WSZ_SQL, _re2

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.items(I.read(spark, sf_dir, "documents"))


#: What lines begin with in turn, so that every rule meets something.
MARKS = (
    "Fig. 3 ", "Table 12. ", "사진 4 ", "1) note ", "* note ", "Contents ", "目次 ", "목차(계속) ", "Chapter one ..... 12 ", "[도면 3] ", "lorem ipsum ", "the image contains ", "주거지 3호 Ⅳ층 ",
    "(단위: cm) 12.5 cm ", "カタカナ 漢字 ", "a b c d e ", "plain ",
)
_MARKS_SQL = "[" + ", ".join("'" + m.replace("'", "''") + "'" for m in MARKS) + "]"
_PLANTED = f"planted AS (SELECT doc_id, pos, page_no, CASE WHEN pos % 4 = 3 THEN left(text, 40) || ' ..... ' || (pos % 90) ELSE {_MARKS_SQL}[pos % {len(MARKS)} + 1] || text END AS text FROM items)"


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.element_at(F.array(*map(F.lit, MARKS)), (F.col("pos") % len(MARKS) + 1).cast("int"))
    leader = F.concat(F.substring("text", 1, 40), F.lit(" ..... "), (F.col("pos") % 90).cast("string"))
    return lines(spark, sf_dir).select("doc_id", "pos", "page_no", F.when(F.col("pos") % 4 == 3, leader).otherwise(F.concat(mark, "text")).alias("text"))


_KINDS = {
    "captions": f"regexp_matches(text, '{_re2(fixed.CAPTION)}')", "orphan_captions": f"regexp_matches(text, '{_re2(fixed.ORPHAN_CAPTION)}')", "footnotes": f"regexp_matches(text, '{_re2(fixed.FOOTNOTE)}')",
    "placeholders": f"""regexp_matches(text, '(?i){"|".join(map(_re2, fixed.PLACEHOLDERS))}')""", "page_numbers": f"regexp_matches(text, '{_re2(fixed.PAGE_NUMBER)}')",
    "resource_entries": " OR ".join(f"regexp_matches(text, '{_re2(p)}')" for p in fixed.RESOURCE_INDEX),
    "toc_keywords": " OR ".join(f"contains(lower(text), '{w}')" for w in dict.fromkeys(w.lower() for w in fixed.TOC_KEYWORDS)),
    "continuations": " OR ".join(f"contains(lower(text), '{w}')" for w in dict.fromkeys(w.lower() for w in fixed.CONTINUATION_MARKERS)),
    "meta": f"""regexp_matches(text, '{"|".join(map(_re2, fixed.META_KOREAN))}') OR regexp_matches(text, '(?i){"|".join(fixed.META_ENGLISH)}')""",
}


@query(f"WITH {I.ITEMS_SQL}, {_PLANTED} SELECT doc_id, {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in _KINDS.items())} FROM planted GROUP BY doc_id")
def planted_line_kinds(spark, sf_dir):
    """F5-F8, F11, F12, F22 over lines that hold what they look for."""
    t = F.col("text")
    rules = {"captions": T.looks_like_caption, "orphan_captions": T.looks_like_orphan_caption, "footnotes": T.looks_like_footnote, "placeholders": T.placeholder, "page_numbers": T.ends_in_page_number, "resource_entries": T.is_resource_index, "toc_keywords": T.is_toc_keyword, "continuations": T.is_continuation, "meta": T.meta_description}
    return planted(spark, sf_dir).groupBy("doc_id").agg(*(F.count_if(f(t)).alias(n) for n, f in rules.items()))


@query(f"WITH {I.ITEMS_SQL}, {_PLANTED} SELECT doc_id, pos, " + ", ".join(f"array_to_string(list_slice(regexp_extract_all(text, '{_re2(p)}'), 1, 5), ';') AS {n}" for n, p in fixed.DOMAIN_PATTERNS.items()) + " FROM planted")
def planted_domain_patterns(spark, sf_dir):
    """F14, L6."""
    return planted(spark, sf_dir).select("doc_id", "pos", *(F.array_join(T.domain_hits(F.col("text"), n), ";").alias(n) for n in fixed.DOMAIN_PATTERNS))


@query(rf"""WITH {I.ITEMS_SQL}, {_PLANTED}, c AS (SELECT doc_id, sum(len(regexp_extract_all(text, '[\x{{AC00}}-\x{{D7AF}}]'))) AS ko, sum(len(regexp_extract_all(text, '[\x{{3040}}-\x{{309F}}\x{{30A0}}-\x{{30FF}}]'))) AS ja, sum(len(regexp_extract_all(text, '[A-Za-z]'))) AS en FROM planted GROUP BY doc_id)
SELECT doc_id, ko::BIGINT AS ko, ja::BIGINT AS ja, en::BIGINT AS en FROM c""")
def planted_scripts(spark, sf_dir):
    """A10, A11."""
    count = lambda c, n: F.sum(F.regexp_count("text", F.lit(f"[{c}]"))).cast("long").alias(n)
    return planted(spark, sf_dir).groupBy("doc_id").agg(count(T.HANGUL, "ko"), count(T.KANA, "ja"), count(T.LATIN, "en"))


@query(f"""WITH {I.ITEMS_SQL}, {_PLANTED} SELECT doc_id, pos, coalesce(nullif(regexp_extract(regexp_replace(regexp_replace(text, '^{WS_SQL}+', ''), '{WS_SQL}+$', ''), '^(\\d+[).]|[*†‡])', 1), ''), '') AS marker, regexp_matches(text, '^\\d+[.)]') AS enumerated,
array_to_string(list_distinct(regexp_extract_all(text, '\\((?:단위\\s*:\\s*)?(cm|mm|km|kg|m|g|%)\\)', 1)), ',') AS units FROM planted""")
def planted_markers(spark, sf_dir):
    """F12, F16, F32."""
    t = F.col("text")
    return planted(spark, sf_dir).select("doc_id", "pos", F.coalesce(T.footnote_marker(t), F.lit("")).alias("marker"), T.is_enumerated(t).alias("enumerated"), F.array_join(T.unit_hints(t), ",").alias("units"))


@query(f"""WITH {I.ITEMS_SQL}, t AS (SELECT doc_id, pos, label, unnest(list_distinct([page_no, page_no + CASE WHEN pos % 5 = 0 THEN 1 ELSE 0 END])) AS page_no FROM items WHERE label IN ('section_header', 'text', 'list_item') AND pos % 7 <> 3)
SELECT doc_id, page_no, pos AS ordinal, label FROM t""")
def page_texts(spark, sf_dir):
    """P5: texts that stand on two pages count on both; other labels don't."""
    prov = F.array(F.struct("page_no"), F.struct((F.col("page_no") + F.when(F.col("pos") % 5 == 0, 1).otherwise(0)).alias("page_no")))
    t = lines(spark, sf_dir).select("doc_id", F.col("pos").alias("ordinal"), F.when(F.col("pos") % 7 == 3, "formula").otherwise(F.col("label")).alias("label"), prov.alias("prov"))
    return C.page_texts(t).select("doc_id", "page_no", "ordinal", "label")


@query(f"""WITH {I.ITEMS_SQL} SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY pos) AS place FROM items WHERE pos % 3 <> 1""")
def unused_blocks(spark, sf_dir):
    """J7, O3."""
    i = lines(spark, sf_dir)
    return C.unused(i, i.where("pos % 3 = 1").select("doc_id", "pos")).select("doc_id", "pos", F.col("place").cast("long").alias("place"))


@query(f"""WITH {I.ITEMS_SQL}, t AS (SELECT * FROM items WHERE label = 'list_item')
SELECT a.doc_id, a.self_ref, b.self_ref AS near_ref, CASE WHEN b.page_no < a.page_no THEN 'before' ELSE 'after' END AS side FROM t a JOIN t b ON a.doc_id = b.doc_id AND abs(a.page_no - b.page_no) = 1""")
def adjacent_tables(spark, sf_dir):
    """J13."""
    return C.adjacent(lines(spark, sf_dir).where("label = 'list_item'"))


@query(f"""WITH {I.ITEMS_SQL}, r AS (SELECT *, sum((pos % 4 <> 2)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM items), x AS (SELECT * FROM r WHERE pos % 4 <> 2), w AS (SELECT * FROM r WHERE pos % 4 = 2)
SELECT w.doc_id, w.self_ref, coalesce(string_agg(x.self_ref, ',' ORDER BY x.n) FILTER (x.n <= w.n), '') AS before, coalesce(string_agg(x.self_ref, ',' ORDER BY x.n) FILTER (x.n > w.n), '') AS after
FROM w JOIN x ON w.doc_id = x.doc_id AND x.n BETWEEN w.n - 1 AND w.n + 2 GROUP BY ALL""")
def nearby_texts(spark, sf_dir):
    """J15."""
    return C.nearby_texts(lines(spark, sf_dir), F.col("pos") % 4 != 2, 2)


@query(f"""WITH {I.ITEMS_SQL}, p AS (SELECT doc_id, left(text, 12) AS t, arg_max(pos, pos) AS number FROM items WHERE pos % 3 <> 0 GROUP BY ALL) SELECT i.doc_id, i.pos, p.number FROM items i LEFT JOIN p ON i.doc_id = p.doc_id AND left(i.text, 12) = p.t""")
def recovered_captions(spark, sf_dir):
    """J16."""
    i = lines(spark, sf_dir).withColumn("full_text", F.substring("text", 1, 12))
    return C.recovered(i, i.where("pos % 3 <> 0").select("doc_id", "full_text", F.col("pos").alias("number"), F.col("pos").alias("seq"))).select("doc_id", "pos", "number")


@query(f"""WITH {I.ITEMS_SQL}, e AS (SELECT doc_id, pos AS owner, unnest([pos + 2, pos + 500, pos, pos + 1]) AS id, unnest([0, 1, 2, 3]) AS nth FROM items WHERE pos % 5 = 0)
SELECT e.doc_id, owner, e.id, row_number() OVER (PARTITION BY e.doc_id, owner ORDER BY nth) AS place FROM e JOIN items i ON i.doc_id = e.doc_id AND i.pos = e.id""")
def resources_by_id(spark, sf_dir):
    """J19, G10."""
    i = lines(spark, sf_dir)
    p = F.col("pos")
    return C.by_ids(i.where("pos % 5 = 0").select("doc_id", p.alias("owner"), F.array(p + 2, p + 500, p, p + 1).alias("ids")), i.select("doc_id", p.alias("id"))).select("doc_id", "owner", "id", F.col("place").cast("long").alias("place"))


@query(f"WITH {I.ITEMS_SQL} SELECT doc_id, page_no, string_agg(self_ref, ',' ORDER BY pos) AS tables FROM items WHERE label = 'list_item' GROUP BY ALL")
def tables_by_page(spark, sf_dir):
    """A6."""
    t = C.listed_by_page(lines(spark, sf_dir).where("label = 'list_item'"), F.col("self_ref"), "tables")
    return t.withColumn("tables", F.array_join("tables", ","))


@query("""WITH c AS (SELECT l_orderkey AS table_id, l_linenumber AS row, l_partkey % 4 AS col, l_linenumber <= 1 OR l_suppkey % 9 = 0 AS h, l_partkey % 4 = 0 AS s FROM lineitem)
SELECT table_id, coalesce(array_to_string(list_sort(list_distinct(list(row) FILTER (h))), ','), '') AS header_rows, coalesce(array_to_string(list_sort(list_distinct(list(col) FILTER (s))), ','), '') AS header_cols FROM c GROUP BY table_id""")
def header_offsets(spark, sf_dir):
    """A9."""
    c = I.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), (F.col("l_partkey") % 4).alias("col"), ((F.col("l_linenumber") <= 1) | (F.col("l_suppkey") % 9 == 0)).alias("column_header"), (F.col("l_partkey") % 4 == 0).alias("row_header"))
    return C.header_offsets(c).select("table_id", *(F.array_join(x, ",").alias(x) for x in ("header_rows", "header_cols")))


@query("SELECT user_id AS page, event_type AS id, min(event_id) AS seq FROM events GROUP BY ALL")
def first_issues(spark, sf_dir):
    """A16."""
    return C.first_by_id(I.read(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_type").alias("id"), F.col("event_id").alias("seq")))


@query("""WITH p AS (SELECT user_id % 20 AS run, CASE WHEN event_id % 7 <> 0 THEN event_id % 5 END AS texts, CASE WHEN event_id % 7 <> 0 THEN event_id % 3 END AS cells FROM events)
SELECT run, coalesce(sum(texts), 0)::BIGINT AS texts, coalesce(sum(cells), 0)::BIGINT AS cells, count(*) FILTER (texts IS NULL) AS failed_pages, count(*) AS pages FROM p GROUP BY run""")
def correction_totals(spark, sf_dir):
    """A22."""
    ok = F.col("event_id") % 7 != 0
    return C.correction_totals(I.read(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("run"), F.when(ok, F.col("event_id") % 5).alias("texts"), F.when(ok, F.col("event_id") % 3).alias("cells")))


@query(f"WITH {I.ITEMS_SQL} SELECT doc_id, label, count(*) AS n, count(DISTINCT page_no) AS pages FROM items GROUP BY ALL")
def node_counts(spark, sf_dir):
    """A23."""
    return lines(spark, sf_dir).groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.countDistinct("page_no").alias("pages"))


@query(f"""WITH {I.BOXES_SQL}, o AS (SELECT page, list(n ORDER BY n) AS a, list(n ORDER BY y0, x0, n) AS b FROM boxes GROUP BY page)
SELECT page, len([i FOR i IN range(1, len(a) + 1) IF a[i] <> b[i]])::BIGINT AS mismatch FROM o""")
def order_mismatch(spark, sf_dir):
    """Reading order against visual order."""
    o = I.boxes(I.read(spark, sf_dir, "lineitem")).groupBy("page").agg(F.array_sort(F.collect_list("n")).alias("a"), F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "n"))), lambda x: x["n"]).alias("b"))
    return o.select("page", C.order_mismatch(F.col("a"), F.col("b")).cast("long").alias("mismatch"))


_GROUPS = f"""g AS (SELECT doc_id, pos // 5 AS k, min(page_no) AS page_no, CASE pos // 5 % 3 WHEN 0 THEN 'list' WHEN 1 THEN 'group' ELSE 'other' END AS name, count(*) AS n, count(*) FILTER (regexp_matches(text, '{_re2(fixed.PAGE_NUMBER)}')) AS hits FROM planted GROUP BY ALL),
l AS (SELECT *, name <> 'other' AND (hits >= 3 OR hits > 0.5 * n) AS contents_like FROM g)"""


def _groups(spark, sf_dir) -> DataFrame:
    k = F.floor(F.col("pos") / 5).cast("long")
    name = F.when(F.col("k") % 3 == 0, "list").when(F.col("k") % 3 == 1, "group").otherwise("other")
    g = planted(spark, sf_dir).groupBy("doc_id", k.alias("k")).agg(F.min("page_no").alias("page_no"), F.collect_list("text").alias("texts"), F.count("*").alias("n"))
    return C.contents_like_groups(g.withColumn("name", name))


@query(f"WITH {I.ITEMS_SQL}, {_PLANTED}, {_GROUPS} SELECT doc_id, k, hits AS page_numbers, contents_like FROM l")
def contents_like_groups(spark, sf_dir):
    """T14."""
    return _groups(spark, sf_dir).select("doc_id", "k", "page_numbers", "contents_like")


@query(f"""WITH {I.ITEMS_SQL}, {_PLANTED}, {_GROUPS}, s AS (SELECT doc_id, k, page_no, ((10 - page_no + 1) * 10 + n * 2 + hits * 5)::BIGINT AS score FROM l WHERE contents_like AND page_no <= 10)
SELECT doc_id, k, page_no, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) = 1""")
def best_contents(spark, sf_dir):
    """The best place for a list of contents among the first pages."""
    g = _groups(spark, sf_dir).where("contents_like and page_no <= 10")
    s = g.select("doc_id", "k", "page_no", toc.text_score(F.col("page_no"), F.col("n"), F.col("page_numbers")).cast("long").alias("score"), F.col("k").alias("ord"))
    return C.best_candidate(s).select("doc_id", "k", "page_no", "score")


@query(f"""WITH RECURSIVE {I.ITEMS_SQL}, {_PLANTED}, {_GROUPS}, s AS (SELECT doc_id, page_no, ((10 - page_no + 1) * 10 + n * 2 + hits * 5) AS score, k FROM l WHERE contents_like AND page_no <= 10),
b AS (SELECT doc_id, page_no AS p FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) = 1), c AS (SELECT DISTINCT doc_id, page_no FROM l WHERE contents_like),
back AS (SELECT doc_id, p FROM b UNION ALL SELECT back.doc_id, back.p - 1 FROM back JOIN c ON c.doc_id = back.doc_id AND c.page_no = back.p - 1),
ahead AS (SELECT doc_id, p FROM b UNION ALL SELECT ahead.doc_id, ahead.p + 1 FROM ahead JOIN c ON c.doc_id = ahead.doc_id AND c.page_no = ahead.p + 1 AND ahead.p + 1 <= 10)
SELECT doc_id, (SELECT min(p) FROM back WHERE back.doc_id = b.doc_id) AS start_page, (SELECT max(p) FROM ahead WHERE ahead.doc_id = b.doc_id) AS end_page FROM b""")
def contents_area(spark, sf_dir):
    """Contents go on over neighbouring pages."""
    g = _groups(spark, sf_dir).where("contents_like")
    s = g.where("page_no <= 10").select("doc_id", "page_no", toc.text_score(F.col("page_no"), F.col("n"), F.col("page_numbers")).alias("score"), F.col("k").alias("ord"))
    return C.contents_area(C.best_candidate(s).select("doc_id", "page_no"), g.select("doc_id", "page_no"))


@query(f"""WITH {I.ITEMS_SQL}, {_PLANTED}, f AS (SELECT doc_id, pos // 6 AS k, text FROM planted WHERE pos % 2 = 0)
SELECT doc_id * 1000 + k AS table_id, count(*) FILTER ({_KINDS["resource_entries"]}) > 0.5 * count(*) AS resource_index FROM f GROUP BY ALL""")
def resource_index_tables(spark, sf_dir):
    """T15."""
    c = planted(spark, sf_dir).select((F.col("doc_id") * 1000 + F.floor(F.col("pos") / 6)).cast("long").alias("table_id"), (F.col("pos") % 2).alias("col"), "text")
    return C.resource_index_tables(c)


_PAGES = "pg AS (SELECT doc_id, page_no, page_no % 4 = 0 AS used FROM (SELECT DISTINCT doc_id, page_no FROM items))"


def _pages(spark, sf_dir) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "page_no").distinct().withColumn("used", F.col("page_no") % 4 == 0)


@query(f"""WITH {I.ITEMS_SQL}, {_PAGES}, p AS (SELECT *, count(*) FILTER (NOT used) OVER (PARTITION BY doc_id) AS spare FROM pg),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('s:' || doc_id || ':' || page_no)) AS place FROM p WHERE spare = 0 OR NOT used) SELECT doc_id, page_no, place FROM r WHERE place <= 3""")
def sampled_pages(spark, sf_dir):
    """L9."""
    return C.sampled(_pages(spark, sf_dir), "s").select("doc_id", "page_no", F.col("place").cast("long").alias("place"))


@query(f"WITH {I.ITEMS_SQL}, {_PAGES}, m AS (SELECT *, max(page_no) OVER (PARTITION BY doc_id) AS last FROM pg) SELECT doc_id, page_no FROM m WHERE page_no <= 10 OR (last > 20 AND page_no > last - 10)")
def edge_pages(spark, sf_dir):
    """L10."""
    return C.edge_pages(_pages(spark, sf_dir)).select("doc_id", "page_no")


@query(f"""WITH {I.ITEMS_SQL}, t AS (SELECT doc_id, max(page_no) AS n FROM items GROUP BY doc_id), c AS (SELECT doc_id, n, unnest(range(0, (n - 1) // 4 + 1)) AS chunk FROM t)
SELECT doc_id, chunk, chunk * 4 + 1 AS first_page, least((chunk + 1) * 4, n) AS last_page FROM c""")
def page_chunks(spark, sf_dir):
    """L11, C6."""
    return C.page_chunks(lines(spark, sf_dir).groupBy("doc_id").agg(F.max("page_no").alias("total_pages")), 4)


@query(f"""WITH {I.ITEMS_SQL}, r AS (SELECT doc_id, pos, string_split(text, ' ') AS c FROM items), g AS (SELECT doc_id, sum(len(c)) AS cells, list(list_slice(c, 1, 8) ORDER BY pos) AS p FROM r GROUP BY doc_id)
SELECT doc_id, md5(array_to_string([array_to_string(x, '|') FOR x IN list_slice(p, 1, 8)], chr(10))) AS preview, cells <= 600 AS whole FROM g""")
def grid_preview(spark, sf_dir):
    """L13."""
    g = lines(spark, sf_dir).withColumn("c", F.split("text", " ")).groupBy("doc_id").agg(F.sum(F.size("c")).alias("cells"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]).alias("g"))
    v = g.withColumn("v", C.previewed(F.col("g"), F.col("cells")))
    return v.select("doc_id", F.md5(F.array_join(F.transform("v.preview", lambda r: F.array_join(r, "|")), "\n")).alias("preview"), F.col("v.full").isNotNull().alias("whole"))


@query(f"WITH {I.ITEMS_SQL}, {_PAGES} SELECT doc_id, page_no, (page_no - 1) // 10 AS batch FROM pg WHERE page_no <= 10 OR (page_no <= 20 AND doc_id % 2 = 0)")
def head_batches(spark, sf_dir):
    """L14."""
    p = _pages(spark, sf_dir)
    return C.head_pages(p, p.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 10).otherwise(3).alias("end_page")).distinct()).select("doc_id", "page_no", "batch")


@query(f"""WITH {I.ITEMS_SQL}, a AS (SELECT doc_id, list(label ORDER BY pos) AS x, list(label || page_no % 2 ORDER BY pos) AS y FROM items GROUP BY doc_id), u AS (SELECT doc_id, unnest(x || y) AS v, generate_subscripts(x || y, 1) AS nth FROM a),
f AS (SELECT doc_id, v, min(nth) AS nth FROM u GROUP BY ALL) SELECT doc_id, string_agg(v, ',' ORDER BY nth) AS labels FROM f GROUP BY doc_id""")
def distinct_unions(spark, sf_dir):
    """O2."""
    ordered = lambda c, n: F.transform(F.array_sort(F.collect_list(F.struct("pos", c.alias("v")))), lambda x: x["v"]).alias(n)
    a = lines(spark, sf_dir).groupBy("doc_id").agg(ordered(F.col("label"), "x"), ordered(F.concat("label", (F.col("page_no") % 2).cast("string")), "y"))
    return a.select("doc_id", F.array_join(C.distinct_union(F.col("x"), F.col("y")), ",").alias("labels"))


@query(f"""WITH {I.ITEMS_SQL}, {_PLANTED}, p AS (SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY pos) AS text FROM planted GROUP BY ALL)
SELECT doc_id, page_no, CASE WHEN regexp_matches(text, '(?i){"|".join(map(_re2, fixed.PLACEHOLDERS))}') THEN 'placeholder_text' ELSE '' END AS placeholder, ({_KINDS["meta"]}) AS meta,
 length(regexp_replace(text, '{WS_SQL}+', '', 'g')) >= 20 AND len(regexp_extract_all(text, '[\\x{{AC00}}-\\x{{D7AF}}\\x{{4E00}}-\\x{{9FFF}}]')) < 0.1 * length(regexp_replace(text, '{WS_SQL}+', '', 'g')) AS anomaly FROM p""")
def page_verdicts(spark, sf_dir):
    """V17, F22, F23."""
    p = planted(spark, sf_dir).groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    v = p.withColumn("v", C.page_verdict(F.col("text"), "ko"))
    has = lambda x: F.array_contains("v", x)
    return v.select("doc_id", "page_no", F.when(has("placeholder_text"), "placeholder_text").otherwise("").alias("placeholder"), has("meta_description").alias("meta"), has("script_anomaly").alias("anomaly"))


@query(f"""WITH {I.ITEMS_SQL}, w AS (SELECT DISTINCT doc_id, page_no FROM items WHERE pos % 9 = 4) SELECT i.doc_id, i.self_ref, i.page_no, md5(i.text) AS text, CASE WHEN pos % 4 = 1 THEN 'ocr_noise' ELSE '' END AS suspect FROM items i JOIN w USING (doc_id, page_no) WHERE pos % 5 <> 2""")
def packed_context(spark, sf_dir):
    """P12, P14, P15."""
    suspect = F.when(F.col("pos") % 5 == 2, F.array(F.lit("picture_internal_text"))).when(F.col("pos") % 4 == 1, F.array(F.lit("ocr_noise"))).otherwise(F.array().cast("array<string>"))
    b = lines(spark, sf_dir).withColumn("suspect", suspect).withColumn("bbox", F.lit(None).cast("string"))
    return C.packed(b, b.where("pos % 9 = 4"), "text_integrity").select("doc_id", "self_ref", "page_no", F.md5("text").alias("text"), F.array_join("suspect", ",").alias("suspect"))


@query(f"""WITH RECURSIVE {I.ITEMS_SQL}, n AS (SELECT doc_id, pos, CASE WHEN pos % 14 = 0 THEN NULL WHEN pos % 14 = 13 THEN pos - 13 ELSE pos - 1 END AS parent FROM items),
w AS (SELECT doc_id, pos, 1 AS level, printf('%06d', pos) AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.doc_id, n.pos, w.level + 1, w.path || '/' || printf('%06d', n.pos) FROM n JOIN w ON n.doc_id = w.doc_id AND n.parent = w.pos)
SELECT doc_id, pos, level::BIGINT AS level, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS reading_order FROM w""")
def reading_order_deep(spark, sf_dir):
    """Chains of thirteen levels, whose roots have a second child."""
    p = F.col("pos")
    n = lines(spark, sf_dir).select("doc_id", p.alias("id"), F.when(p % 14 == 13, p - 13).when(p % 14 != 0, p - 1).alias("parent"), p.alias("ordinal"))
    return nodes.reading_order(n).join(chapters.subtree(n).select("doc_id", "id", "level"), ["doc_id", "id"]).select("doc_id", F.col("id").alias("pos"), F.col("level").cast("long").alias("level"), F.col("reading_order").cast("long").alias("reading_order"))


@query(f"""WITH {I.ITEMS_SQL}, {I.TOC_SQL}, ranges AS (SELECT doc_id, k, start_page, coalesce(lead(start_page) OVER (PARTITION BY doc_id ORDER BY start_page, k) - 1, 9007199254740991) AS end_page FROM toc),
hit AS (SELECT i.doc_id, r.k, i.label FROM items i JOIN ranges r ON i.doc_id = r.doc_id AND i.page_no BETWEEN r.start_page AND r.end_page),
a AS (SELECT doc_id, count(DISTINCT k) AS chapters, count(*) FILTER (label = 'text') AS texts, count(*) FILTER (label = 'list_item') AS tables FROM hit GROUP BY doc_id),
d AS (SELECT doc_id, max(page_no) AS pages FROM items GROUP BY doc_id), t AS (SELECT doc_id, count(*) AS entries, count(*) FILTER (trim(title) = '') AS untitled FROM toc GROUP BY doc_id)
SELECT d.doc_id, pages, coalesce(entries, 0) AS entries, coalesce(untitled, 0) AS untitled, coalesce(chapters, 0) AS chapters, coalesce(texts, 0) AS texts, coalesce(tables, 0) AS tables FROM d LEFT JOIN a USING (doc_id) LEFT JOIN t USING (doc_id)""")
def processed_documents(spark, sf_dir):
    """Documents through contents, ranges and assignment to a summary of each, texts read once for all of it."""
    from docloom.operators.process import process

    return process(lines(spark, sf_dir), I.toc).select("doc_id", "pages", "entries", "untitled", "chapters", "texts", "tables")
