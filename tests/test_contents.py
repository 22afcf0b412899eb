"""Contents: stages and growth in special cases, lists of several levels, sources; corrections of tables meet every rule."""

from pyspark.sql import functions as F

from docloom.operators import assemble
from docloom.operators import contents as C
from docloom.plans import tables as P

TEXT = "doc_id long, ord long, ref string, parent_ref string, page_no long, text string"
EDGE = "doc_id long, parent_ref string, child_ref string, child_pos long"
GROUP = "doc_id long, ord long, ref string, name string"
TABLE = "doc_id long, ord long, ref string, page_no long, is_index boolean, rows long, contents_like boolean, resource_index boolean"
PIECE = "doc_id long, ref string, kind string, page_no long, text string, enumerated boolean, marker string, rows array<array<string>>"


def area(spark, texts, groups=(), tables=(), edges=()):
    t, e = spark.createDataFrame(texts, TEXT), spark.createDataFrame(list(edges), EDGE)
    g, b = spark.createDataFrame(list(groups), GROUP), spark.createDataFrame(list(tables), TABLE)
    pieces = t.select("doc_id", "ref", "page_no", "text").unionByName(b.select("doc_id", "ref", "page_no", F.lit(None).cast("string").alias("text")))
    return {r["doc_id"]: (r["stage"], r["start_page"], r["end_page"], r["refs"]) for r in C.find(t, C.group_facts(g, e, pieces), b, e).collect()}


def test_a_keyword_without_parent_is_the_area_and_does_not_grow(spark):
    listed = [(1, i, f"#/texts/{i}", "#/groups/0", 4, f"Part {i} ..... {i}") for i in range(1, 5)]
    got = area(spark, [(1, 0, "#/texts/0", None, 3, "Contents"), *listed], [(1, 0, "#/groups/0", "list")], (), [(1, "#/groups/0", f"#/texts/{i}", i) for i in range(1, 5)])
    assert got == {1: ("keyword", 3, 3, ["#/texts/0"])}


def test_structure_prefers_contents_to_lists_of_figures_and_grows(spark):
    texts = [(1, i, f"#/texts/{i}", "#/groups/0", 2, f"Part {i} ..... {i}") for i in range(4)] + [(1, 9, "#/texts/9", "#/groups/1", 12, "Contents")]
    tables = [(1, 0, "#/tables/0", 1, True, 3, True, True), (1, 1, "#/tables/1", 3, False, 4, True, False), (1, 2, "#/tables/2", 5, False, 4, True, False)]
    got = area(spark, texts, [(1, 0, "#/groups/0", "list"), (1, 1, "#/groups/1", "list")], tables, [(1, "#/groups/0", f"#/texts/{i}", i) for i in range(4)])
    assert got == {1: ("structure", 2, 3, ["#/groups/0", "#/tables/1"])}


def test_siblings_and_rings(spark):
    texts = [(1, 0, "#/texts/0", "#/body", 1, "차례"), (2, 0, "#/texts/0", "#/texts/1", 1, "차례"), (2, 1, "#/texts/1", "#/texts/0", 1, "x")]
    table = (1, 0, "#/tables/0", 1, True, 3, True, False)
    assert area(spark, texts, (), [table], [(1, "#/body", "#/texts/0", 0), (1, "#/body", "#/texts/7", 1), (1, "#/body", "#/tables/0", 3)]) == {1: ("keyword", 1, 1, ["#/tables/0"])}


def test_lists_of_three_levels_tables_and_rings(spark):
    text = lambda i, s, **k: (1, f"#/texts/{i}", "text", 1, s, k.get("enumerated"), k.get("marker"), None)
    pieces = [text(0, "one"), text(1, " two ", enumerated=True), text(2, "three", marker="*"), text(3, "  "), text(4, "alone"), *[(1, f"#/groups/{i}", kind, None, None, None, None, None) for i, kind in enumerate(["list", "list", "list", "other"])]]
    pieces += [(1, "#/tables/0", "table", 1, None, None, None, [["a|b", " c\nd "], [], ["1", None]])]
    edges = [(1, "#/groups/0", "#/texts/0", 0), (1, "#/groups/0", "#/groups/1", 1), (1, "#/groups/0", "#/texts/3", 2), (1, "#/groups/1", "#/groups/2", 0), (1, "#/groups/1", "#/texts/1", 1), (1, "#/groups/2", "#/texts/2", 0), (1, "#/groups/2", "#/groups/0", 1), (1, "#/groups/0", "#/tables/0", 3), (1, "#/groups/0", "#/groups/3", 4), (1, "#/groups/3", "#/texts/4", 0)]
    starts = spark.createDataFrame([(1, 0, "#/groups/0"), (1, 1, "#/tables/0"), (1, 2, "#/texts/4"), (1, 3, "#/texts/99"), (2, 0, "#/texts/0")], "doc_id long, pos long, ref string")
    got = {r["doc_id"]: r["markdown"] for r in C.markdown(starts, spark.createDataFrame(pieces, PIECE), spark.createDataFrame(edges, EDGE)).collect()}
    assert got == {1: "- one\n    * three\n  1. two\n\n| a\\|b | c d |\n| --- | --- |\n| 1 |  |\n\n- alone", 2: ""}


def test_sources_in_their_order(spark):
    docs = spark.createDataFrame([(i, 10) for i in range(5)], "doc_id long, pages long")
    ruled = spark.createDataFrame([(0, "A ..... 9"), (1, "B ..... 99"), (2, None), (3, "D")], "doc_id long, markdown string")
    seen = spark.createDataFrame([(0, "a"), (2, "c ..... 4"), (3, "d")], "doc_id long, markdown string")
    made = spark.createDataFrame([(0, "rules", 3), (1, "rules", 2), (2, "vision", 1), (3, "rules", 0), (3, "vision", 5)], "doc_id long, source string, entries long")
    got = [tuple(r) for r in C.cascade(docs, ruled, seen, made).orderBy("doc_id").collect()]
    assert got == [(0, "rules", "A ..... 9", 3, 10, None), (1, "rules", "B ..... 99", 2, None, None), (2, "vision", "c ..... 4", 1, 10, None), (3, "vision", "d", 5, 10, None), (4, None, None, 0, None, "not_located")]


def test_documents_without_sizes_boxes_or_media(spark):
    schema = "doc_id long, page_no long, ord long, seq long, type string, content string, level long, marker string, bbox struct<l:double,t:double,r:double,b:double>"
    e = spark.createDataFrame([(1, 2, 0, 0, "caption", "lost", None, None, (0.0, 0.0, 1.0, 1.0)), (1, 1, 5, 0, "table", None, None, None, None), (1, 1, 5, 1, "caption", "of it", None, None, None), (1, 1, 9, 0, "page_footer", "\U0001f600", None, None, None)], schema)
    none = spark.createDataFrame([], "doc_id long, page_no long, width double, height double")
    d = assemble.assembled(e, none, spark.createDataFrame([(1, "n", "f")], "doc_id long, name string, filename string")).collect()[0]
    assert [x["ref"] for x in d["body"]["children"]] == ["#/tables/0", "#/texts/0", "#/texts/2"] and [x["ref"] for x in d["furniture"]["children"]] == ["#/texts/1"]
    assert [x["ref"] for x in d["tables"][0]["captions"]] == ["#/texts/0"] and d["texts"][1]["prov"][0]["charspan"] == [0, 2] and d["texts"][2]["prov"][0]["bbox"]["r"] == 0 and sorted(d["pages"]) == ["1", "2"]


def test_table_corrections_meet_every_rule(spark):
    seen = {r["r"].split(":")[0] for r in P.found(spark, "/root/testdata/sf0.01").select(F.explode("reasons").alias("r")).distinct().collect()}
    assert len(seen) == 15, sorted(seen)
