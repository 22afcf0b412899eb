"""Redirects, gutters, captions, published tables: special cases."""

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docloom.operators import captions, gutters, navigation
from docloom.plans import navigation as plans
from docloom.sources import publish

CHAPTER = "doc_id long, id string, parent string, ord long, page long, contents long"


def test_redirects_keep_to_their_page_and_parent(spark):
    rows = [(1, "a", None, 0, 5, 0), (1, "b", "a", 1, 6, 1), (1, "c", "b", 2, 5, 1), (1, "d", "a", 3, 5, 0), (1, "e", "d", 4, 5, 0), (1, "f", "e", 5, 5, 2), (1, "g", None, 6, 5, 1), (1, "h", None, 7, None, 0), (1, "i", "h", 8, None, 1), (1, "ring", "ring", 9, 5, 0), (1, "k", "b", 10, 9, 0), (1, "l", None, 11, 9, 1)]
    got = {r["id"]: r["target"] for r in navigation.redirects(spark.createDataFrame(rows, CHAPTER)).collect()}
    assert got == {"a": "f", "d": "f", "e": "f", "h": None, "k": None}
    assert navigation.redirects(spark.createDataFrame([], CHAPTER)).count() == 0


def test_gutters_at_edges_and_of_no_bins(spark):
    low, ink = 0.0, 0.5
    rows = [([],), ([low] * 50,), ([low] * 10 + [ink] * 40,), ([ink] * 40 + [low] * 10,), ([ink] * 20 + [low] * 5 + [ink] * 25,), ([ink] * 10 + [low] * 5 + [ink] * 10 + [low] * 5 + [ink] * 20,), ([0.1] * 20 + [low] * 5 + [ink] * 25,)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, d array<double>").select("i", gutters.runs(F.col("d")).alias("r"), gutters.best_gutter(F.col("d")).alias("g")).orderBy("i").collect()
    assert [[tuple(x) for x in r["r"]] for r in d][:3] == [[], [(0, 50)], [(0, 10)]]
    assert [r["g"] and (r["g"]["start"], r["g"]["end"]) for r in d] == [None, None, None, None, (20, 25), (10, 15), None]
    assert d[4]["g"]["score"] == pytest.approx(1.0)


def test_captions_without_validator_or_second_parser(spark):
    given = spark.createDataFrame([(1, 0, "Fig. 1"), (1, 1, None), (1, 2, "Fig. 2"), (2, 0, "Fig. 1"), (2, 1, "Fig. 1")], "doc_id long, idx long, text string")
    parsed = spark.createDataFrame([(1, 0, "1", "Fig. 1"), (1, 1, "2", "Fig. 2"), (2, 0, "1", "Fig. 1")], "doc_id long, place long, num string, full_text string")
    out = lambda *a: sorted(tuple(r) for r in captions.processed(given, parsed, *a).collect())
    assert out(None, None) == [(1, 0, "1", "Fig. 1", "parsed"), (1, 2, "2", "Fig. 2", "parsed"), (2, 0, "1", "Fig. 1", "recovered"), (2, 1, "1", "Fig. 1", "recovered")]
    verdicts = spark.createDataFrame([(1, 1, False)], "doc_id long, place long, is_valid boolean")
    assert out(verdicts, None)[1] == (1, 2, "2", "Fig. 2", "doubtful")
    assert out(verdicts, spark.createDataFrame([(1, 0, "9", "Nine")], parsed.schema))[1] == (1, 2, "9", "Nine", "reparsed")


def test_failed_writers_leave_the_table(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    assert publish.published(spark, path) is None and publish.keep_origin(spark, path) is None
    publish.publish(spark.range(3), path)
    with pytest.raises(PySparkException):
        publish.publish(spark.range(5).select(F.raise_error(F.lit("lost")).cast("long").alias("id")), path)
    assert publish.published(spark, path).count() == 3
    publish.keep_origin(spark, path)
    publish.rewrite(spark, path, lambda t: t.where("id > 0"))
    publish.rewrite(spark, path, lambda t: t.where("id > 1"))
    assert publish.published(spark, path).count() == 1 and publish.keep_origin(spark, path).count() == 3
    assert publish.sweep(spark, path) == 2 and publish.sweep(spark, path) == 0
    assert publish.published(spark, path).count() == 1 and publish.published(spark, path, publish.ORIGIN).count() == 3


def test_checkpoints_belong_to_a_run_and_a_version(spark, tmp_path):
    path, schema = f"file://{tmp_path}/check", "item string, failed boolean"
    read = lambda run, version: [tuple(r) for r in publish.read_checkpoint(spark, path, run, version, schema).collect()]
    assert read("r1", 1) == []
    publish.write_checkpoint(spark.createDataFrame([("a", False)], schema), path, "r1", 1)
    assert read("r1", 1) == [("a", False)] and read("r2", 1) == [] and read("r1", 2) == []
    (tmp_path / "check" / ".CURRENT.crc").unlink(missing_ok=True)
    (tmp_path / "check" / "CURRENT").write_text("{broken")
    assert read("r1", 1) == []


def test_gutter_scores_at_halves_of_the_last_digit(spark, tmp_path):
    ids = [86224, 17824, 94408]
    spark.createDataFrame([(i,) for i in ids], "doc_id long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"SET threads = 1; CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = plans.picture_gutters(spark, str(tmp_path)).select("doc_id", "runs", "score", "start_bin", "end_bin").collect()
    assert sorted(map(tuple, found)) == sorted(duck.execute(plans.ORACLE_SQL["picture_gutters"]).fetchall())
    bins = spark.createDataFrame([([0.1, 0.2, 0.3],)], "d array<double>")
    assert bins.select(gutters.average(F.col("d"), F.lit(0), F.lit(3))).first()[0] == (0.3 + 0.2 + 0.1) / 3
