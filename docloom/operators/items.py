"""Projections of the test tables onto the document model: lines as items, contents entries, boxes, usage, tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_A_PAGE = 3


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def items(docs: DataFrame) -> DataFrame:
    """One row a line, with its place, page, label and reference."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    label = F.when(F.col("pos") == 0, "section_header").when(F.col("text").contains(" | "), "list_item").otherwise("text")
    return lines.select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "text", (F.floor(F.col("pos") / LINES_A_PAGE) + 1).cast("long").alias("page_no"),
        label.alias("label"), F.concat(F.lit("#/texts/"), F.col("pos").cast("string")).alias("self_ref"),
    )


def toc(lines: DataFrame) -> DataFrame:
    """Contents entries: every fourth line names the chapter that starts on its page."""
    return lines.where("pos % 4 = 1").select("doc_id", F.floor(F.col("pos") / 4).cast("long").alias("k"), F.col("text").alias("title"), F.col("page_no").alias("start_page"))


def boxes(lineitem: DataFrame) -> DataFrame:
    """Boxes on pages 1000 units wide and high: a page an order."""
    return lineitem.select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("n"),
        (F.col("l_quantity").cast("double") * 10).alias("x0"), (F.col("l_discount").cast("double") * 5000).alias("y0"),
        (F.col("l_quantity").cast("double") * 10 + F.col("l_tax").cast("double") * 4000 + 20).alias("x1"),
        (F.col("l_discount").cast("double") * 5000 + (F.col("l_partkey") % 50 + 10).cast("double") * 4).alias("y1"), (F.col("l_suppkey") % 3).cast("long").alias("kind"),
    )


def usage(events: DataFrame) -> DataFrame:
    """Model calls: component, phase, role, model and tokens of each."""
    return events.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("component"), (F.col("user_id") % 3).cast("long").alias("phase"),
        F.when(F.col("event_id") % 5 == 0, "fallback").otherwise("primary").alias("role"), F.concat(F.lit("model-"), (F.col("user_id") % 4).cast("string")).alias("model"),
        F.floor(F.coalesce(F.col("value"), F.lit(0.0)) * 10).cast("long").alias("tokens_in"), F.floor(F.coalesce(F.col("value"), F.lit(0.0))).cast("long").alias("tokens_out"), F.col("ts").cast("timestamp").alias("ts"),
    )


def tasks(orders: DataFrame) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    return orders.select(F.col("o_orderkey").alias("task_id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_custkey").alias("session_id"), (F.col("o_orderkey") % 97 == 0).alias("is_sample"))


# the same projections in DuckDB SQL, for the oracles
ITEMS_SQL = """items AS (SELECT doc_id, pos - 1 AS pos, text, (pos - 1) // 3 + 1 AS page_no,
  CASE WHEN pos = 1 THEN 'section_header' WHEN contains(text, ' | ') THEN 'list_item' ELSE 'text' END AS label, '#/texts/' || (pos - 1) AS self_ref
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))"""
TOC_SQL = "toc AS (SELECT doc_id, pos // 4 AS k, text AS title, page_no AS start_page FROM items WHERE pos % 4 = 1)"
BOXES_SQL = """boxes AS (SELECT l_orderkey AS page, l_linenumber::BIGINT AS n, l_quantity::DOUBLE * 10 AS x0, l_discount::DOUBLE * 5000 AS y0,
  l_quantity::DOUBLE * 10 + l_tax::DOUBLE * 4000 + 20 AS x1, l_discount::DOUBLE * 5000 + (l_partkey % 50 + 10)::DOUBLE * 4 AS y1, (l_suppkey % 3)::BIGINT AS kind FROM lineitem)"""
USAGE_SQL = """usage AS (SELECT event_id AS seq, event_type AS component, (user_id % 3)::BIGINT AS phase, CASE WHEN event_id % 5 = 0 THEN 'fallback' ELSE 'primary' END AS role,
  'model-' || (user_id % 4) AS model, floor(coalesce(value, 0) * 10)::BIGINT AS tokens_in, floor(coalesce(value, 0))::BIGINT AS tokens_out, ts FROM events)"""
TASKS_SQL = """tasks AS (SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END AS status,
  o_orderdate::TIMESTAMP AS created_at, o_custkey AS session_id, o_orderkey % 97 = 0 AS is_sample FROM orders)"""
