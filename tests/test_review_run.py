"""The review run: rounds, what goes into the next, what is lost, what is ruled on."""

from pyspark.sql import functions as F

from docloom.operators import commands as V, review_run
from docloom.plans import commands as P
from tests.test_commands import BLOCKS, COMMAND


def test_two_rounds_more_one_item_lost_snapshots_kept(spark):
    blocks = spark.createDataFrame([(1, 1, n, f"#/texts/{n}", "text", "some text", [], None, None, None, None, None, None, None) for n in range(4)], BLOCKS)
    pages = spark.createDataFrame([(1, 1, 100.0, 80.0)], "doc_id long, page long, width double, height double")
    contexts = V.contexts(blocks, pages, spark.createDataFrame([], "doc_id long, page long, ref string"))
    names = [f.split()[0] for f in COMMAND.split(", ")]
    said = {(0, 1): "#/texts/0", (1, 1): "#/texts/9", (1, 2): "#/texts/8", (1, 3): "#/texts/1", (2, 1): "#/texts/9", (2, 2): "#/texts/9", (2, 3): "#/texts/9"}
    heard = []

    def provider(opened, attempt):
        heard.append({r["item"]: r["feedback"] for r in opened.collect()})
        rows = [(*({"doc_id": 1, "page": 1, "answer_page": 1, "seq": i, "op": "replaceText", "ref": ref, "text": "t", "confidence": 0.9}.get(k) for k in names), i) for (i, a), ref in said.items() if a == attempt and i in heard[-1]]
        return spark.createDataFrame(rows, COMMAND + ", item long")

    items = spark.createDataFrame([(1, 1, i, None) for i in range(4)], "doc_id long, page long, item long, task string")
    r = review_run.run(items, provider, contexts, 3)
    assert sorted((x["item"], x["attempts"], x["status"], x["feedback"]) for x in r.items.collect()) == [(0, 1, "passed", []), (1, 3, "reasked", ["target_ref_not_found"]), (2, 3, "failed", ["target_ref_not_found"]), (3, 1, "passed", [])]
    assert heard == [{0: [], 1: [], 2: [], 3: []}, {1: ["target_ref_not_found"], 2: ["target_ref_not_found"]}, {1: ["target_ref_not_found"], 2: ["target_ref_not_found"]}]
    assert [t.count() for t in r.rounds] == [4, 2, 2] and sorted(x["ref"] for x in r.decisions.collect()) == ["#/texts/0", "#/texts/1"]
    assert review_run.lost_pages(r.items).count() == 0 and review_run.lost_pages(r.items.where("item = 2")).count() == 1
    strange = review_run.run(items.withColumn("task", F.lit("tables")).where("item = 0"), provider, contexts, 1)
    assert [(x["status"], x["feedback"]) for x in strange.items.collect()] == [("failed", ["task_op_not_allowed:replaceText"])]


def test_all_outcomes_occur(spark):
    r = P.reviewed(spark, "/root/testdata/sf0.01")
    assert {x["status"] for x in r.items.select("status").distinct().collect()} == {"passed", "reasked", "failed"}
    ruled = review_run.ruled_on(r.decisions.withColumn("signature", F.expr(P._SIGNATURE)))
    assert {x["disposition"] for x in ruled.select("disposition").distinct().collect()} == {"auto_applied", "proposal", "skipped"}
    assert 0 < r.decisions.count() - ruled.count()
