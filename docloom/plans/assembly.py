"""Raw documents from page elements, exploded again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import assemble, items as I, nodes
from docloom.plans.commands import Duck, Spark
from docloom.plans.context import lines

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TYPES = ("section_header", "text", "caption", "picture", "caption", "table", "caption", "list_item", "page_header", "page_footer", "caption")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _element(d) -> list[str]:
    """Lines as elements: pages come in any order, places within a page repeat, some have no box, no level, no marker."""
    box = d.box("(pos % 7) / 10.0E0", "(pos % 5) / 10.0E0", "(pos % 7) / 10.0E0 + 0.25E0", "(pos % 5) / 10.0E0 + 0.125E0", "'unit'")
    return [
        "doc_id", "page_no", "pos * 5 % 3 % 2 AS ord", "pos AS seq", f"{d.pick(d.array(*(chr(39) + t + chr(39) for t in TYPES)), f'(doc_id + pos) % {len(TYPES)}')} AS type", "text AS content", "CASE WHEN pos % 2 = 0 THEN pos % 4 END AS level",
        "CASE pos % 4 WHEN 0 THEN '1)' WHEN 1 THEN '12.' WHEN 2 THEN '-' END AS marker", f"CASE WHEN pos % 4 <> 1 THEN {box} END AS bbox",
    ]


_SIZED = "(doc_id + page_no) % 5 <> 0"


def raw(spark, sf_dir) -> DataFrame:
    l = lines(spark, sf_dir)
    pages = l.select("doc_id", "page_no").distinct()
    sizes = pages.where(_SIZED).selectExpr("doc_id", "page_no", "800.0E0 AS width", "1000.0E0 AS height")
    return assemble.assembled(l.selectExpr(*_element(Spark)), sizes, pages.select("doc_id").distinct().selectExpr("doc_id", "'d' || doc_id AS name", "'d' || doc_id || '.pdf' AS filename"))


_ASSEMBLED = f"""{I.ITEMS_SQL}, e AS (SELECT {', '.join(_element(Duck))} FROM items),
o AS (SELECT *, CASE type WHEN 'picture' THEN 'pictures' WHEN 'table' THEN 'tables' ELSE 'texts' END AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, ord, seq) AS place FROM e),
r AS (SELECT *, '#/' || kind || '/' || (row_number() OVER (PARTITION BY doc_id, kind ORDER BY place) - 1) AS ref, type NOT IN ('page_header', 'page_footer') AS in_body FROM o),
c AS (SELECT a.doc_id, a.ref, a.place, (SELECT arg_max(b.ref, b.place) FROM r b WHERE b.doc_id = a.doc_id AND b.page_no = a.page_no AND b.place < a.place AND b.kind <> 'texts') AS owner FROM r a WHERE a.type = 'caption'),
cs AS (SELECT doc_id, owner AS ref, string_agg(ref, ',' ORDER BY place) AS captions FROM c WHERE owner IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {_ASSEMBLED} SELECT doc_id, ref AS self_ref, type AS label, page_no, CASE WHEN kind = 'texts' THEN md5(content) END AS text, CASE WHEN type = 'section_header' THEN level END AS level, CASE WHEN type = 'list_item' THEN coalesce(regexp_matches(marker, '^\\d+[.)]'), false) END AS enumerated,
CASE WHEN type = 'list_item' THEN marker END AS marker, CASE WHEN bbox IS NOT NULL AND {_SIZED} THEN bbox.l * 800 ELSE 0 END AS l, CASE WHEN bbox IS NOT NULL AND {_SIZED} THEN (1 - bbox.b) * 1000 ELSE 0 END AS b, length(content) AS chars, coalesce(captions, '') AS captions,
CASE WHEN in_body THEN 'body' ELSE 'furniture' END AS layer, row_number() OVER (PARTITION BY doc_id, in_body ORDER BY place) - 1 AS place FROM r LEFT JOIN cs USING (doc_id, ref)""")
def assembled_nodes(spark, sf_dir):
    """What explodes from assembled documents is what went in."""
    d = raw(spark, sf_dir)
    at = None
    for layer in ("body", "furniture"):
        part = d.select("doc_id", F.posexplode(f"{layer}.children").alias("place", "c")).select("doc_id", F.col("c.ref").alias("self_ref"), F.lit(layer).alias("layer"), F.col("place").cast("long").alias("place"))
        at = part if at is None else at.unionByName(part)
    none = lambda kind: F.lit(None).cast(kind)
    found = None
    for kind in ("texts", "pictures", "tables"):
        n = nodes.exploded(d, kind)
        texts = kind == "texts"
        p = F.col("prov")[0]
        n = n.select(
            "doc_id", "self_ref", "label", p["page_no"].alias("page_no"), (F.md5("text") if texts else none("string")).alias("text"), (F.col("level") if texts else none("long")).alias("level"), (F.col("enumerated") if texts else none("boolean")).alias("enumerated"), (F.col("marker") if texts else none("string")).alias("marker"),
            p["bbox"]["l"].alias("l"), p["bbox"]["b"].alias("b"), p["charspan"][1].alias("chars"), (F.lit("") if texts else F.array_join(F.transform("captions", lambda x: x["ref"]), ",")).alias("captions"),
        )
        found = n if found is None else found.unionByName(n)
    return found.join(at, ["doc_id", "self_ref"])


@query(f"""WITH {_ASSEMBLED} SELECT doc_id, 'd' || doc_id || '.pdf' AS filename, count(DISTINCT page_no) AS pages, count(DISTINCT page_no) FILTER ({_SIZED}) AS sized, count(*) FILTER (kind = 'texts') AS texts, count(*) FILTER (kind = 'pictures') AS pictures, count(*) FILTER (kind = 'tables') AS tables FROM r GROUP BY doc_id""")
def assembled_documents(spark, sf_dir):
    """The documents' own fields."""
    n = lambda c: F.size(c).cast("long").alias(c)
    sized = F.size(F.filter(F.map_values("pages"), lambda p: p["image"]["size"]["width"] > 0)).cast("long").alias("sized")
    return raw(spark, sf_dir).select("doc_id", F.col("origin.filename").alias("filename"), n("pages"), sized, n("texts"), n("pictures"), n("tables"))


@query(f"""WITH {_ASSEMBLED}, t AS (SELECT c.doc_id, c.owner, string_agg(trim(r.content), ' ' ORDER BY c.place) FILTER (trim(r.content) <> '') AS caption FROM c JOIN r ON r.doc_id = c.doc_id AND r.ref = c.ref WHERE c.owner IS NOT NULL GROUP BY ALL)
SELECT r.doc_id, r.ref AS self_ref, md5(coalesce(t.caption, '')) AS caption, coalesce(len(string_split(cs.captions, ',')), 0) AS parts FROM r LEFT JOIN t ON t.doc_id = r.doc_id AND t.owner = r.ref LEFT JOIN cs ON cs.doc_id = r.doc_id AND cs.ref = r.ref WHERE r.kind <> 'texts'""")
def joined_captions(spark, sf_dir):
    """pictures' and tables' captions, looked up among the texts and joined in order."""
    d = raw(spark, sf_dir)
    texts = nodes.exploded(d, "texts").select("doc_id", "self_ref", "text")
    owners = None
    for kind in ("pictures", "tables"):
        n = nodes.exploded(d, kind).select("doc_id", "self_ref", F.transform("captions", lambda c: F.struct(c["ref"].alias("ref"), F.lit(None).cast("string").alias("text"))).alias("captions"))
        owners = n if owners is None else owners.unionByName(n)
    parts = owners.select("doc_id", "self_ref", F.explode("captions").alias("c")).select("doc_id", "self_ref", F.col("c.ref").alias("ref"))
    found = nodes.resolved(parts, texts.withColumn("kind", nodes.collection_of(F.col("self_ref")))).where("kind = 'texts'").groupBy("doc_id", "self_ref").agg(F.count("*").alias("parts"))
    said = nodes.joined_captions(owners, texts)
    out = owners.select("doc_id", "self_ref").join(said, ["doc_id", "self_ref"], "left").join(found, ["doc_id", "self_ref"], "left")
    return out.select("doc_id", "self_ref", F.md5(F.coalesce("caption", F.lit(""))).alias("caption"), F.coalesce("parts", F.lit(0)).cast("long").alias("parts"))
