"""Commands against pages: every reason occurs, order and special cases as described."""

from pyspark.sql import functions as F

from docloom.operators import commands as V
from docloom.plans import commands as P

COMMAND = "doc_id long, page long, seq long, answer_page long, op string, ref string, other_ref string, text_refs array<string>, text string, parts array<string>, label string, page_no long, box struct<l:double,t:double,r:double,b:double,coord_origin:string>, row long, col long, widths array<int>, caption string, regions array<struct<l:double,t:double,r:double,b:double,coord_origin:string>>, confidence double"
BLOCKS = f"doc_id long, page long, ord long, ref string, kind string, text string, suspect array<string>, rows long, cols long, preview array<int>, box {V.BOX}, candidate boolean, orientation string, suggested int"


def ruled(spark, commands, blocks, size=(100.0, 80.0), evidence=()):
    names = [f.split()[0] for f in COMMAND.split(", ")]
    rows = [tuple({"doc_id": 1, "page": 1, "answer_page": 1, "seq": n, "confidence": 0.9, **c}.get(k) for k in names) for n, c in enumerate(commands)]
    b = spark.createDataFrame([tuple({"doc_id": 1, "page": 1, "ord": n, "suspect": [], **x}.get(f.split(" ")[0]) for f in BLOCKS.split(", ")) for n, x in enumerate(blocks)], BLOCKS)
    pages = spark.createDataFrame([(1, 1, *size, *(evidence or ([], [], [], [], [])))], "doc_id long, page long, width double, height double, missing array<string>, warned array<string>, footnotes array<string>, reading array<string>, visual array<string>")
    c = V.contexts(b, pages, spark.createDataFrame([(1, 1, "#/tables/9")], "doc_id long, page long, ref string"))
    got = V.validated(spark.createDataFrame(rows, COMMAND), c).orderBy("seq").collect()
    return got


def test_later_commands_on_taken_references_fail(spark):
    texts = [{"ref": f"#/texts/{i}", "kind": "text", "text": "a" * 30} for i in range(3)]
    take = lambda op, ref, **more: {"op": op, "ref": ref, **more}
    got = ruled(spark, [take("replaceText", "#/texts/0", text="x"), take("updateTextRole", "#/texts/0", label="text"), take("linkFootnote", "#/texts/1", other_ref="#/texts/0"), take("replaceText", "#/texts/1", text="b" * 20), take("moveNode", "#/texts/2", other_ref="#/texts/2", label="before")], texts)
    assert [r["reasons"] for r in got] == [["replacement_deletes_too_much_text"], [], ["target_already_modified"], [], ["move_self_reference"]]


def test_lengths_are_without_white_space_and_in_utf16_units(spark):
    texts = [{"ref": "#/texts/0", "kind": "text", "text": "a b c d e f g h"}, {"ref": "#/texts/1", "kind": "text", "text": ""}, {"ref": "#/texts/2", "kind": "text", "text": "\U0001f600" * 11}]
    got = ruled(spark, [{"op": "splitText", "ref": "#/texts/0", "parts": ["abcd", "ef  "]}, {"op": "splitText", "ref": "#/texts/1", "parts": ["anything", "else"]}, {"op": "replaceText", "ref": "#/texts/2", "text": "abcdef"}], texts)
    assert [r["reasons"] for r in got] == [[], [], ["replacement_deletes_too_much_text"]]


def test_boxes_from_below_and_missing_sizes(spark):
    box = lambda t, b, origin="BOTTOMLEFT": (10.0, t, 20.0, b, origin)
    commands = [{"op": "addPicture", "box": box(79.0, 60.0)}, {"op": "addPicture", "box": box(81.0, 60.0)}, {"op": "addPicture", "box": box(60.0, 81.0, "TOPLEFT")}, {"op": "addPicture", "box": (float("nan"), 0.0, 1.0, 1.0, None)}]
    assert [r["reasons"] for r in ruled(spark, commands, [{"ref": "#/texts/0", "kind": "text"}])] == [[], ["bbox_outside_page"], ["bbox_outside_page"], ["bbox_non_finite"]]
    assert [r["reasons"] for r in ruled(spark, commands, [{"ref": "#/texts/0", "kind": "text"}], (None, None))] == [[], [], [], ["bbox_non_finite"]]


def test_split_pictures(spark):
    at = lambda l, t, r, b: (float(l), float(t), float(r), float(b), "TOPLEFT")
    picture = {"ref": "#/pictures/0", "kind": "picture", "box": at(10, 10, 90, 70), "candidate": True, "orientation": "grid", "suggested": 4}
    four = [at(10, 10, 40, 30), at(50, 10, 90, 30), at(10, 40, 40, 70), at(50, 40, 90, 70)]
    split = lambda regions: {"op": "splitPicture", "ref": "#/pictures/0", "regions": regions}
    assert ruled(spark, [split(four)], [picture])[0]["reasons"] == []
    assert ruled(spark, [split(four[:2])], [picture])[0]["reasons"] == ["split_picture_region_count_mismatch", "split_picture_boundary_not_supported"]
    assert ruled(spark, [split([four[0], four[0]])], [{**picture, "candidate": False}])[0]["reasons"] == ["split_picture_regions_overlap", "split_picture_without_boundary_candidate"]
    assert ruled(spark, [split([at(0, 0, 200, 10)])], [{**picture, "box": None}])[0]["reasons"] == ["bbox_outside_page", "split_picture_requires_multiple_regions", "split_picture_source_bbox_missing"]


def test_evidence_and_trust(spark):
    texts = [{"ref": f"#/texts/{i}", "kind": "text", "text": "t", "suspect": ["hanja_ocr_candidate"] if i == 0 else []} for i in range(3)]
    refs = [f"#/texts/{i}" for i in range(3)]
    commands = [{"op": "replaceText", "ref": refs[0], "text": "u"}, {"op": "addText", "text": "lost words", "label": "text", "box": (1.0, 1.0, 2.0, 2.0, None)}, {"op": "moveNode", "ref": refs[2], "other_ref": refs[1], "label": "before"}, {"op": "moveNode", "ref": refs[1], "other_ref": refs[0], "label": "after"}]
    got = ruled(spark, commands, texts, evidence=(["lost  words"], [], [], refs, [refs[0], refs[2], refs[1]]))
    assert [(r["trusted"], r["evidenced"]) for r in got] == [(True, False), (False, True), (False, True), (False, False)]


def test_every_reason_occurs(spark):
    seen = P.ruled(spark, "/root/testdata/sf0.01").select(F.explode("reasons").alias("r")).distinct()
    assert seen.count() >= 32


def test_contexts_are_one_shuffle_without_texts(spark):
    b = spark.createDataFrame([(1, 1, n, ref, "text", t, [], None, None, None, None, None, None, None) for n, ref, t in ((2, "a", "later"), (1, "a", "a b"), (3, "b", None))], BLOCKS)
    pages = spark.createDataFrame([(1, 1, 9.0, 8.0), (2, 1, 9.0, 8.0)], "doc_id long, page long, width double, height double")
    c = V.contexts(b, pages, spark.createDataFrame([(1, 1, "t"), (3, 3, "t")], "doc_id long, page long, ref string"))
    rows = sorted(c.collect(), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["width"], r["beside"], {k: (x["chars"], x["inked"]) for k, x in r["blocks"].items()}) for r in rows] == [(1, 9.0, ["t"], {"a": (3.0, 2.0), "b": (None, None)}), (2, 9.0, [], {})]
    commands = P.commands_of(spark.createDataFrame([(1, 0, 1)], "doc_id long, pos long, page_no long"))
    plan = V.validated(commands.withColumn("item", F.col("seq") % 2), c, ("item",)).selectExpr("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
