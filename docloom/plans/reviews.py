"""Queries over review commands and decisions, projected from events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.operators import items as I
from docloom.operators import patch, review

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
OPS = ("replaceText", "removeText", "updateBbox", "moveNode", "updateTableCell", "addText", "hidePicture", "updateTextRole", "mergeTexts", "linkFootnote")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _commands(spark, sf_dir) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    ops = F.array(*map(F.lit, OPS))
    return I.read(spark, sf_dir, "events").select(
        e.alias("id"), e.alias("seq"), F.floor(e / 20).cast("long").alias("page"), F.get(ops, ((e + u) % 10).cast("int")).alias("op"), (u % 6).cast("long").alias("target"),
        (((e * 37) % 101) / 100).alias("confidence"), (e % 11 != 0).alias("valid"), (u % 4 == 0).alias("trusted"), (u % 2 == 0).alias("evidenced"), (u % 3).cast("long").alias("payload"),
    )


_CMD = f"""cmd AS (SELECT event_id AS id, event_id AS seq, event_id // 20 AS page, [{", ".join(f"'{o}'" for o in OPS)}][1 + (event_id + user_id) % 10] AS op, (user_id % 6)::BIGINT AS target,
  ((event_id * 37) % 101) / 100.0::DOUBLE AS confidence, event_id % 11 <> 0 AS valid, user_id % 4 = 0 AS trusted, user_id % 2 = 0 AS evidenced, (user_id % 3)::BIGINT AS payload FROM events)"""
_PEN = " ".join(f"WHEN '{o}' THEN {p}::DOUBLE" for o, p in fixed.RISK_PENALTIES.items())
_BLK = " ".join(f"WHEN '{o}' THEN '{r}'" for o, r in fixed.BLOCK_REASONS.items())
_EVI = ", ".join(f"'{o}'" for o in fixed.EVIDENCED_OPS)
_DISP = f"""{_CMD}, f AS (SELECT *, round(greatest(0, least(1, confidence - CASE WHEN trusted AND op = 'removeText' THEN 0 ELSE coalesce(CASE op {_PEN} END, 0) END)), 9) AS final,
  CASE WHEN op IN ({_EVI}) AND evidenced THEN NULL ELSE CASE op {_BLK} END END AS block, CASE WHEN trusted THEN 0.7 ELSE 0.85 END AS needed FROM cmd),
disp AS (SELECT *, CASE WHEN NOT valid OR final < 0.5 THEN 'skipped' WHEN final >= needed AND block IS NULL THEN 'auto_applied' ELSE 'proposal' END AS disposition FROM f)"""


@query(f"WITH {_DISP} SELECT id, round(final, 6) AS final, disposition, CASE WHEN disposition = 'proposal' THEN CASE WHEN final < needed THEN 'below_auto_apply_threshold' ELSE block END END AS reason FROM disp")
def disposition(spark, sf_dir):
    """V6, V7."""
    return review.dispositions(_commands(spark, sf_dir)).select("id", F.round("final", 6).alias("final"), "disposition", "reason")


@query(f"WITH {_CMD} SELECT id, valid AND row_number() OVER (PARTITION BY page, target, valid ORDER BY seq) = 1 AS valid, CASE WHEN valid AND row_number() OVER (PARTITION BY page, target, valid ORDER BY seq) > 1 THEN 'target_already_touched' END AS touch_reason FROM cmd")
def command_touch(spark, sf_dir):
    """V5."""
    return review.touched_once(_commands(spark, sf_dir)).select("id", "valid", "touch_reason")


_ALLOWED = " OR ".join(f"(task = '{t}' AND op IN ({', '.join(repr(o) for o in ops)}))" for t, ops in fixed.TASK_OPS.items())


@query(f"WITH {_CMD}, t AS (SELECT *, [{', '.join(repr(t) for t in fixed.TASK_OPS)}][1 + target] AS task FROM cmd) SELECT id, task, op FROM t WHERE {_ALLOWED}")
def allowed_ops(spark, sf_dir):
    """P11."""
    tasks = F.array(*map(F.lit, fixed.TASK_OPS))
    return review.allowed(_commands(spark, sf_dir).withColumn("task", F.get(tasks, F.col("target").cast("int")))).select("id", "task", "op")


@query(f"""WITH {_CMD}, s AS (SELECT *, op || ':' || target || ':' || payload AS signature FROM cmd), r AS (SELECT *, row_number() OVER (PARTITION BY page, signature ORDER BY confidence DESC, seq) AS n FROM s),
g AS (SELECT page, signature, count(DISTINCT id % 7) AS n_reasons FROM s GROUP BY ALL) SELECT r.id, r.page, r.signature, round(r.confidence, 6) AS confidence, n_reasons FROM r JOIN g USING (page, signature) WHERE n = 1""")
def decision_dedup(spark, sf_dir):
    """A15."""
    c = _commands(spark, sf_dir).select("id", "seq", "page", "confidence", F.concat_ws(":", "op", F.col("target").cast("string"), F.col("payload").cast("string")).alias("signature"), F.array(F.concat(F.lit("r"), (F.col("id") % 7).cast("string"))).alias("reasons"))
    return review.deduplicated(c).select("id", "page", "signature", F.round("confidence", 6).alias("confidence"), F.size("reasons").cast("long").alias("n_reasons"))


_EDGES = f"{_CMD}, t AS (SELECT id, seq, page, target AS ref FROM cmd WHERE valid UNION ALL SELECT id, seq, page, 10 + (payload + seq) % 9 FROM cmd WHERE valid), h AS (SELECT page, id, first_value(id) OVER (PARTITION BY page, ref ORDER BY seq) AS other FROM t), edges AS (SELECT DISTINCT page, id, other FROM h WHERE id <> other)"


def _edges(spark, sf_dir) -> DataFrame:
    c = _commands(spark, sf_dir).where("valid")
    t = c.select("id", "seq", "page", F.col("target").alias("ref")).unionAll(c.select("id", "seq", "page", 10 + (F.col("payload") + F.col("seq")) % 9))
    return review.conflicts(t)


@query(f"""WITH RECURSIVE {_EDGES}, two AS (SELECT page, id, other FROM edges UNION SELECT page, other, id FROM edges), walk AS (SELECT DISTINCT page, id, id AS z FROM two UNION SELECT w.page, w.id, b.other FROM walk w JOIN two b ON w.page = b.page AND w.z = b.id)
SELECT page, id, min(z) AS root FROM walk GROUP BY ALL""")
def conflict_components(spark, sf_dir):
    """G11, V10."""
    return review.conflict_groups(_edges(spark, sf_dir))


@query(f"""WITH {_DISP}, g AS (SELECT page, target, id, confidence, seq FROM disp WHERE valid QUALIFY count(*) OVER (PARTITION BY page, target) > 1), r AS (SELECT *, row_number() OVER (PARTITION BY page, target ORDER BY confidence DESC, seq) AS n FROM g),
l AS (SELECT page, id, n, round(max(confidence) FILTER (n = 1) OVER (PARTITION BY page, target) - max(confidence) FILTER (n = 2) OVER (PARTITION BY page, target), 9) > 0.3 AS clear FROM r)
SELECT d.id, CASE WHEN n IS NOT NULL AND NOT clear AND disposition = 'auto_applied' THEN 'proposal' ELSE disposition END AS disposition FROM disp d LEFT JOIN l ON d.page = l.page AND d.id = l.id WHERE NOT coalesce(n > 1 AND clear, FALSE)""")
def arbitration(spark, sf_dir):
    """Groups are commands on one target."""
    d = review.dispositions(_commands(spark, sf_dir))
    g = d.where("valid").groupBy("page", "target").agg(F.collect_list("id").alias("ids"), F.min("id").alias("root")).where(F.size("ids") > 1).select("page", F.explode("ids").alias("id"), "root")
    return review.arbitrated(d, g).select("id", "disposition")


@query(f"""WITH {_DISP} SELECT page, count(*) AS decisions, count(*) FILTER (disposition = 'auto_applied') AS auto_applied, count(*) FILTER (disposition = 'proposal') AS proposal, count(*) FILTER (disposition = 'skipped') AS skipped, round(avg(confidence), 6) AS mean_confidence FROM disp GROUP BY ROLLUP (page)""")
def report_summary(spark, sf_dir):
    """A12."""
    return review.report(review.dispositions(_commands(spark, sf_dir)))


@query(f"""WITH {_CMD}, c AS (SELECT page, op AS kind, id, (row_number() OVER (PARTITION BY page, op ORDER BY seq) - 1) // 4 AS chunk FROM cmd)
SELECT page, kind, chunk, string_agg('#/texts/' || id, '+' ORDER BY id) AS refs, 'p' || page || ':' || kind || ':' || string_agg('_texts_' || id, '+' ORDER BY id) AS item_id FROM c GROUP BY page, kind, chunk""")
def work_items(spark, sf_dir):
    """V13, F29."""
    c = _commands(spark, sf_dir).select("page", F.col("op").alias("kind"), F.lit(1).alias("priority"), F.col("seq").alias("ord"), F.concat(F.lit("#/texts/"), F.col("id").cast("string")).alias("ref"))
    w = review.work_items(c)
    return w.select("page", "kind", "chunk", F.array_join("refs", "+").alias("refs"), "item_id")


@query(f"WITH {_CMD} SELECT id FROM cmd WHERE NOT (op = 'addText' AND valid) AND NOT (NOT valid)")
def pending_work(spark, sf_dir):
    """P9, R11."""
    c = _commands(spark, sf_dir).withColumn("item_id", F.col("id"))
    return review.pending(c, c.where("op = 'addText' and valid").select("item_id"), c.where("not valid").select("item_id")).select("id")


@query(f"""WITH {_CMD} SELECT id // 2 AS page FROM cmd GROUP BY ALL HAVING bool_and(NOT valid OR op IN ('addText', 'hidePicture', 'moveNode'))""")
def failed_pages(spark, sf_dir):
    """A page fails only if all its items do."""
    return review.failed_pages(_commands(spark, sf_dir).withColumn("page", F.floor(F.col("id") / 2).cast("long")).withColumn("failed", ~F.col("valid") | F.col("op").isin("addText", "hidePicture", "moveNode")))


@query(f"""WITH {I.ITEMS_SQL} SELECT doc_id, self_ref, md5(CASE WHEN pos % 6 = 2 THEN 'corrected ' || pos ELSE text END) AS text FROM items""")
def corrected_texts(spark, sf_dir):
    """X1, X17."""
    t = I.items(I.read(spark, sf_dir, "documents"))
    c = t.where("pos % 6 = 2").select("doc_id", "self_ref", F.concat(F.lit("corrected "), F.col("pos").cast("string")).alias("text"))
    return patch.replaced_texts(t, c).select("doc_id", "self_ref", F.md5("text").alias("text"))


@query(f"""WITH {I.ITEMS_SQL}, b AS (SELECT doc_id, pos, page_no, label, regexp_replace(text, '[\\t\\n\\x0B\\f\\r ]+', '', 'g') AS n, text FROM items),
a AS (SELECT doc_id, n FROM b WHERE length(n) >= 2 GROUP BY ALL HAVING count(DISTINCT page_no) >= 2)
SELECT b.doc_id, count(*) FILTER (n = '') AS empty_text, count(*) FILTER (a.n IS NOT NULL) AS repeated_across_pages FROM b LEFT JOIN a USING (doc_id, n) GROUP BY b.doc_id""")
def issue_counts(spark, sf_dir):
    """Issues of each kind in a document."""
    s = review.suspect_reasons(I.items(I.read(spark, sf_dir, "documents")))
    return s.groupBy("doc_id").agg(*(F.count_if(F.array_contains("reasons", r)).alias(r) for r in ("empty_text", "repeated_across_pages")))


@query()
def patched_documents(spark, sf_dir):
    """Whole documents after a fold of commands."""
    t = I.items(I.read(spark, sf_dir, "documents"))
    node = F.struct("self_ref", "text", "label")
    docs = t.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", node.alias("n")))), lambda x: x["n"]).alias("texts"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "self_ref"))), lambda x: x["self_ref"]).alias("c"))
    docs = docs.select("doc_id", F.to_json(F.struct("texts", F.struct(F.col("c").alias("children")).alias("body"))).alias("document"))
    one = lambda op, **f: F.to_json(F.struct(F.lit(op).alias("op"), *(v.alias(k) for k, v in f.items())))
    cmd = t.select("doc_id", F.col("pos").alias("seq"), F.when(F.col("pos") % 3 == 0, one("replaceText", textRef=F.col("self_ref"), text=F.lit("x"))).when(F.col("pos") % 3 == 1, one("removeText", textRef=F.col("self_ref"))).otherwise(one("moveNode", sourceRef=F.col("self_ref"), targetRef=F.lit("#/texts/0"), position=F.lit("before"))).alias("command"))
    return patch.patched(docs, cmd).select("doc_id", F.size(F.filter("outcomes", lambda x: x.startswith("applied"))).cast("long").alias("applied"), F.md5("document").alias("digest"))
