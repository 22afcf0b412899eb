"""Steps whose cost once grew with more than their input: how often rows are parted, how many go to Python at once."""

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import assemble, patch

ELEMENT = "doc_id long, page_no long, ord long, seq long, type string, content string, level long, marker string, bbox struct<l:double,t:double,r:double,b:double,coord_origin:string>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_elements_are_parted_once(spark):
    e = spark.createDataFrame([(1, 1, 0, 0, "picture", "", None, None, None), (1, 1, 1, 1, "caption", "c", None, None, None), (1, 2, 0, 2, "text", "t", None, None, None)], ELEMENT)
    sizes = spark.createDataFrame([(1, 2, 10.0, 20.0)], "doc_id long, page_no long, width double, height double")
    d = assemble.assembled(e, sizes, spark.createDataFrame([(1, "n", "f")], "doc_id long, name string, filename string"))
    assert plan(d).count("Exchange hashpartitioning") <= 3
    r = d.first()
    assert [[c["ref"] for c in p["captions"]] for p in r["pictures"]] == [["#/texts/0"]] and {k: v["size"]["width"] for k, v in r["pages"].items()} == {"1": 0.0, "2": 10.0}


def test_documents_are_patched_some_at_a_time(spark):
    docs = spark.createDataFrame([(i, '{"texts": [{"self_ref": "a", "text": "x"}]}') for i in range(100)], "doc_id long, document string")
    commands = spark.createDataFrame([(i, 1, '{"op": "replaceText", "textRef": "a", "text": "y"}') for i in range(50, 101)], "doc_id long, seq long, command string")
    out = patch.patched(docs, commands)
    assert "FLOOR" in plan(out)
    got = {r["doc_id"]: (r["outcomes"], '"y"' in r["document"]) for r in out.collect()}
    assert got == {i: (["applied"], True) if i >= 50 else ([], False) for i in range(100)}


def test_characters_are_counted_in_one_pass(spark):
    a = "".join(map(chr, range(0x4E00, 0x9000)))
    d = spark.createDataFrame([(a, a[::-1]), (a, None), ("", a), ("aab\U0001f600", "ab\U0001f600\U0001f600")], "a string, b string").select(T.char_overlap(F.col("a"), F.col("b")).alias("x"))
    assert "ArrowEvalPython" in plan(d) and [r["x"] for r in d.collect()] == [1.0, None, 0.0, 0.75]
