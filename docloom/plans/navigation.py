"""Content redirects, gutters of pictures, captions through two parsers, published tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import captions, gutters, items as I, navigation
from docloom.plans.context import lines
from docloom.sources import publish
from docloom.sources.shared import shared_folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Trees of twelve lines, some ten levels deep, four lines a page, one chapter in three with contents.
_CHAPTER = "doc_id, pos AS id, CASE WHEN pos % 12 = 0 THEN NULL WHEN pos % 12 IN (5, 9) THEN pos - 3 WHEN pos % 12 = 11 THEN pos - 11 ELSE pos - 1 END AS parent, pos AS ord, page_no - page_no % 2 AS page, CASE WHEN (doc_id + pos) % 3 = 0 THEN 1 ELSE 0 END AS contents"


@query(f"""WITH RECURSIVE {I.ITEMS_SQL}, ch AS (SELECT {_CHAPTER} FROM items),
tr AS (SELECT *, [ord] AS path FROM ch WHERE parent IS NULL UNION ALL SELECT c.*, list_append(t.path, c.ord) FROM ch c JOIN tr t ON c.doc_id = t.doc_id AND c.parent = t.id),
dn AS (SELECT c.doc_id, c.id AS empty_id, d.id, d.contents, d.path FROM tr c JOIN tr d ON c.doc_id = d.doc_id AND c.page = d.page AND c.contents = 0 AND (d.parent = c.id OR (d.parent IS NOT DISTINCT FROM c.parent AND d.ord > c.ord))
 UNION ALL SELECT n.doc_id, n.empty_id, d.id, d.contents, d.path FROM dn n JOIN tr x ON x.doc_id = n.doc_id AND x.id = n.id JOIN tr d ON d.doc_id = n.doc_id AND d.parent = n.id AND d.page = x.page)
SELECT t.doc_id, t.id, (SELECT arg_min(n.id, n.path) FROM dn n WHERE n.doc_id = t.doc_id AND n.empty_id = t.id AND n.contents > 0) AS target FROM tr t WHERE t.contents = 0""")
def content_redirects(spark, sf_dir):
    """C11."""
    return navigation.redirects(lines(spark, sf_dir).selectExpr(*_split(_CHAPTER)))


def _split(columns: str) -> list[str]:
    """The expressions of a select list, cut at commas outside of parentheses."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[last:i])
            last = i + 1
    return [*out, columns[last:]]


_N = "(40 + doc_id % 57)"
_BIN = f"CASE WHEN i >= doc_id * 3 % {_N} AND i < doc_id * 3 % {_N} + doc_id % 9 OR (doc_id % 4 = 0 AND i BETWEEN 20 AND 22) THEN (i % 4) * 0.02E0 WHEN doc_id % 5 = 0 THEN 0.07E0 + (doc_id * 7 + i * 13) % 20 / 100.0E0 ELSE 0.2E0 + (doc_id * 7 + i * 13) % 50 / 100.0E0 END"


@query(f"""WITH b AS (SELECT doc_id, {_N} AS n, i, {_BIN} AS d FROM documents, LATERAL (SELECT unnest(range({_N})) AS i) x),
l AS (SELECT doc_id, n, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b WHERE d <= 0.06), r AS (SELECT doc_id, n, min(i) AS s, max(i) + 1 AS e FROM l GROUP BY doc_id, n, g),
a AS (SELECT r.doc_id, r.n, s, e, coalesce(avg(d) FILTER (i < s), 0) AS x, coalesce(avg(d) FILTER (i >= e), 0) AS y, avg(d) FILTER (i >= s AND i < e) AS z FROM r JOIN b ON b.doc_id = r.doc_id GROUP BY ALL),
k AS (SELECT *, 0.35 * (1 - z) + 0.45 * least(1, least(x, y) / 0.45) + 0.2 * least(1, (e - s) / greatest(1, n * 0.08)) AS score FROM a WHERE e - s >= greatest(1, ceil(n * 0.025)) AND s > n * 0.08 AND e < n * 0.92 AND x >= 0.18 AND y >= 0.18)
SELECT d.doc_id, (SELECT count(*) FROM r WHERE r.doc_id = d.doc_id) AS runs, round(max(score), 6) AS score, arg_max(s, score)::BIGINT AS start_bin, arg_max(e, score)::BIGINT AS end_bin FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id""")
def picture_gutters(spark, sf_dir):
    """W15, M10."""
    bins = F.expr(f"transform(sequence(0L, {_N} - 1), i -> {_BIN})")
    d = I.read(spark, sf_dir, "documents").select("doc_id", bins.alias("d"))
    best = gutters.best_gutter(F.col("d"))
    g = d.select("doc_id", F.size(gutters.runs(F.col("d"))).cast("long").alias("runs"), best.alias("g"))
    score = F.round(F.col("g.score") * 1e6) / 1e6  # halves as DuckDB's round takes them: by the scaled double, not by its shortest decimal
    return g.select("doc_id", "runs", score.alias("score"), F.col("g.start").cast("long").alias("start_bin"), F.col("g.end").cast("long").alias("end_bin"))


_GIVEN = "CASE WHEN pos % 5 = 3 THEN NULL WHEN pos % 7 = 2 THEN 'Fig. 1 same' ELSE 'Fig. ' || pos || ' ' || text END"


@query(f"""WITH {I.ITEMS_SQL}, g AS (SELECT doc_id, pos AS idx, {_GIVEN} AS text FROM items), v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS place FROM g WHERE text IS NOT NULL),
p AS (SELECT doc_id, 'N' || place AS num, text AS full_text, place FROM v WHERE doc_id % 3 <> 1 OR place % 4 <> 1), c AS (SELECT doc_id, count(*) AS asked, count(*) FILTER (doc_id % 3 <> 1 OR place % 4 <> 1) AS got FROM v GROUP BY 1),
l AS (SELECT doc_id, full_text AS text, arg_max(num, place) AS num FROM p GROUP BY ALL),
a AS (SELECT v.doc_id, v.idx, p.num, p.full_text, false AS recovered FROM v JOIN c USING (doc_id) JOIN p USING (doc_id, place) WHERE asked = got UNION ALL SELECT v.doc_id, v.idx, l.num, l.text, true FROM v JOIN c USING (doc_id) JOIN l USING (doc_id, text) WHERE asked <> got),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS kth FROM a), w AS (SELECT *, kth % 10 = 0 OR kth % 6 <> 5 AS ok FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ok ORDER BY idx) - 1 AS nth FROM w)
SELECT doc_id, idx, CASE WHEN NOT ok AND nth % 4 <> 3 THEN 'R' || nth ELSE num END AS num, md5(CASE WHEN NOT ok AND nth % 4 <> 3 THEN 'again' ELSE full_text END) AS full_text, CASE WHEN NOT ok THEN CASE WHEN nth % 4 <> 3 THEN 'reparsed' ELSE 'doubtful' END WHEN recovered THEN 'recovered' ELSE 'parsed' END AS outcome FROM b""")
def processed_captions(spark, sf_dir):
    """C4, V14, J16."""
    given = lines(spark, sf_dir).selectExpr("doc_id", "pos AS idx", f"{_GIVEN} AS text")
    valid = captions.numbered(given.where("text is not null"))
    parsed = valid.where("doc_id % 3 <> 1 or place % 4 <> 1").selectExpr("doc_id", "place", "'N' || place AS num", "text AS full_text")
    places = valid.select("doc_id", "place")
    verdicts = places.where("place % 10 <> 0").selectExpr("doc_id", "place", "place % 6 <> 5 AS is_valid")
    again = places.where("place % 4 <> 3").selectExpr("doc_id", "place", "'R' || place AS num", "'again' AS full_text")
    return captions.processed(given, parsed, verdicts, again).select("doc_id", "idx", "num", F.md5("full_text").alias("full_text"), "outcome")


@query(f"WITH {I.ITEMS_SQL} SELECT 'origin' AS state, doc_id, pos, md5(text) AS text FROM items UNION ALL SELECT 'current', doc_id, pos, md5(text || '!!') FROM items WHERE pos % 2 = 0")
def published_lines(spark, sf_dir):
    """A table published, rewritten twice, its first state kept."""
    path = shared_folder(spark, "published")
    publish.publish(lines(spark, sf_dir).select("doc_id", "pos", "text"), path)
    publish.keep_origin(spark, path)
    publish.rewrite(spark, path, lambda t: t.where("pos % 2 = 0"))
    publish.rewrite(spark, path, lambda t: t.withColumn("text", F.concat("text", F.lit("!!"))))
    at = lambda state, df: df.select(F.lit(state).alias("state"), "doc_id", "pos", F.md5("text").alias("text"))
    return at("origin", publish.keep_origin(spark, path)).unionByName(at("current", publish.published(spark, path)))
