import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.operators import chapters, nodes, pages, patch, providers, resources, review, spatial, toc
from docloom.sources import documents as src
from docloom.streaming import tasks as streams


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_equal_starts_leave_the_last_chapter_the_page(spark):
    t = spark.createDataFrame([(1, 0, 3), (1, 1, 3), (1, 2, 5)], "doc_id long, k long, start_page long")
    items = spark.createDataFrame([(1, p, p, f"#/texts/{p}") for p in range(1, 8)], "doc_id long, page_no long, pos long, self_ref string")
    ranges = chapters.chapter_ranges(t, front_matter=True)
    assert rows(ranges.where("k < 2"), "k", "start_page", "end_page") == [(-1, 1, 2), (0, 3, 2), (1, 3, 4)]
    assert rows(chapters.assign(items, ranges), "page_no", "k") == [(1, -1), (2, -1), (3, 1), (4, 1), (5, 2), (6, 2), (7, 2)]


def test_unmapped_pages_stay_zero(spark):
    items = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "doc_id long, page_no long")
    ranges = spark.createDataFrame([(1, 1, 0), (1, 2, 11)], "doc_id long, pdf_page long, start_page long")
    assert rows(chapters.actual_pages(items, ranges), "page_no", "page") == [(1, 0), (2, 11), (3, 3)]


def test_ids_keep_all_digits(spark):
    assert spark.range(1).select(chapters.padded_id("ch-", F.lit(1000))).first()[0] == "ch-1000"


def repaired(numbers):
    out = list(numbers)
    for i in range(1, len(out)):
        if out[i] > 0 and out[i - 1] > 0 and out[i - 1] - out[i] > 1:
            for j in range(i):
                out[j] = out[i] - (i - j)
    return out


def test_drop_repair_equals_the_loop(spark):
    r = random.Random(4)
    docs = {d: [r.choice([0, *range(1, 12)]) for _ in range(r.randint(1, 9))] for d in range(120)}
    df = spark.createDataFrame([(d, i + 1, n) for d, ns in docs.items() for i, n in enumerate(ns)], "doc_id long, page long, number long")
    got = {d: [n for _, n in sorted((p, n) for x, p, n in rows(pages.repair_drops(df), "doc_id", "page", "number") if x == d)] for d in docs}
    assert got == {d: repaired(n) for d, n in docs.items()}


def test_page_steps(spark):
    df = spark.createDataFrame([(1, 1, 90), (1, 2, 11), (1, 3, 12), (1, 4, 13), (1, 5, 0)], "doc_id long, page long, number long")
    assert rows(pages.drop_outliers(df), "page", "number")[0] == (1, 0)
    assert rows(pages.post_processed(df), "page", "number") == [(1, 10), (2, 11), (3, 12), (4, 13), (5, 14)]
    p = pages.pattern(spark.createDataFrame([(1, 1, 1), (1, 2, 3), (1, 3, 5), (2, 1, 0), (2, 2, 4)], "doc_id long, page long, number long"))
    assert rows(p, "doc_id", "pattern") == [(1, "double_sided"), (2, "unknown")]
    x = pages.extrapolated(df.select("doc_id", "page"), p, spark.createDataFrame([(1, 2, 3)], "doc_id long, page long, number long"))
    assert rows(x, "page", "start_page", "end_page")[2] == (3, 5, 6)


def test_toc_rules(spark):
    e = spark.createDataFrame([(1, 0, None, "A", 60), (1, 1, 0, " ", 50), (1, 2, 0, "x" * 201, 70), (1, 3, None, "A", 60), (1, 4, None, "Z", 101)], "doc_id long, k long, parent long, title string, page long")
    found = rows(toc.issues(e, spark.createDataFrame([(1, 100)], "doc_id long, total_pages long")), "k", "code")
    assert found == [(0, "V007"), (1, "V001"), (1, "V003"), (1, "V005"), (2, "V004"), (3, "V006"), (4, "V002")]


def test_references(spark):
    n = spark.createDataFrame([(1, "#/texts/0", "a"), (1, "#/texts/1", "b")], "doc_id long, self_ref string, text string")
    r = spark.createDataFrame([(1, 0, "#/texts/1"), (1, 1, "#/texts/9"), (1, 2, None)], "doc_id long, pos long, ref string")
    assert [x[1] for x in rows(nodes.resolved(r, n), "pos", "text")] == ["b", None, None]
    assert rows(nodes.unresolved(r.where("ref is not null"), n), "ref") == [("#/texts/9",)]
    assert [x[0] for x in spark.createDataFrame([("#/texts/1",), ("x",)], "r string").select(nodes.collection_of(F.col("r"))).collect()] == ["texts", None]
    assert spark.range(1).select(nodes.shifted_ref(F.lit("#/texts/3"), "texts", F.lit(4)), nodes.shifted_ref(F.lit("#/tables/3"), "texts", F.lit(4))).first()[:] == ("#/texts/7", "#/tables/3")


def test_captions_join_in_order(spark):
    owners = spark.createDataFrame([(1, "#/pictures/0", [("#/texts/1", None), (None, " given "), ("#/texts/7", None), ("#/texts/0", None)])], "doc_id long, self_ref string, captions array<struct<ref:string,text:string>>")
    t = spark.createDataFrame([(1, "#/texts/0", " a"), (1, "#/texts/1", "b ")], "doc_id long, self_ref string, text string")
    assert nodes.joined_captions(owners, t).first()["caption"] == "b given a"


def test_grid(spark):
    c = spark.createDataFrame([("t", 0, 0, 0, 0, "a"), ("t", 0, 1, 0, 0, "shadow"), ("t", 1, 0, 0, 0, "shadow"), ("t", 1, 1, None, None, "b")], "table_id string, row long, col long, start_row long, start_col long, text string")
    assert rows(resources.anchored_grid(c), "row", "anchor_col", "text") == [(0, 0, "a"), (1, 1, "b")]
    assert rows(resources.cells_to_rows(c.where("row = 1")), "row", "texts") == [(0, []), (1, ["shadow", "b"])]
    v = lambda e: spark.range(1).select(e.alias("x")).first()[0]
    assert v(resources.span(F.lit(2), F.lit(2), F.lit(3))) == 3 and v(resources.span(F.lit(2), F.lit(4), F.lit(3))) == 2
    assert v(resources.pipe_table(F.array(F.array(F.lit("h"), F.lit("i|")), F.array(F.lit("1"), F.lit("2"))))) == "| h | i\\| |\n| --- | --- |\n| 1 | 2 |"
    s = spark.createDataFrame([("t", 0, 0, 2, 2)], "table_id string, row long, col long, row_span long, col_span long")
    assert rows(resources.shadows(s), "row", "col") == [(0, 1), (1, 0), (1, 1)]


def test_greedy_matches(spark):
    found = spark.createDataFrame([(1, 0, "abcd"), (1, 1, "abce")], "page long, n long, text string")
    blocks = spark.createDataFrame([(1, 0, "abce"), (1, 1, "abcd"), (1, 2, "zzzz")], "page long, n long, text string")
    assert rows(spatial.match_texts(found, blocks), "n", "block", "same") == [(0, 1, True), (1, 0, True)]
    pairs = spark.createDataFrame([(1, 0, 5, 0.9, 0.1), (1, 1, 5, 0.99, 0.1), (1, 1, 6, 0.6, 0.2), (1, 2, 7, 0.9, 0.5)], "page long, target long, caption long, score double, distance double")
    assert rows(spatial.greedy_captions(pairs), "target", "caption") == [(0, 5), (1, 6)]


DOC = {
    "body": {"children": ["#/texts/0", "#/pictures/0", "#/texts/1"]}, "groups": [],
    "texts": [{"self_ref": "#/texts/0", "text": "a", "orig": "a", "label": "text", "prov": []}, {"self_ref": "#/texts/1", "text": "b", "orig": "b", "label": "text", "prov": [{"page_no": 1, "bbox": 1}]}],
    "pictures": [{"self_ref": "#/pictures/0", "captions": ["#/texts/1"], "prov": [{"page_no": 1, "bbox": 1}]}],
    "tables": [{"self_ref": "#/tables/0", "grid": [[{"text": "x"}]], "captions": []}],
}


def test_patch():
    run = lambda *c: patch.apply_commands(json.loads(json.dumps(DOC)), list(c))
    d, done = run({"op": "replaceText", "textRef": "#/texts/0", "text": "z"}, {"op": "replaceText", "textRef": "#/texts/9", "text": "z"}, {"op": "nothing"})
    assert d["texts"][0]["text"] == "z" and done[0] == "applied" and all(x.startswith("patch_skipped") for x in done[1:])
    d, _ = run({"op": "removeText", "textRef": "#/texts/1"})
    assert d["body"]["children"] == ["#/texts/0", "#/pictures/0"] and d["pictures"][0]["captions"] == [] and len(d["texts"]) == 2
    d, _ = run({"op": "splitText", "textRef": "#/texts/0", "parts": [{"text": "p"}, {"text": "q", "label": "caption"}]})
    assert d["body"]["children"] == ["#/texts/0", "#/texts/2", "#/pictures/0", "#/texts/1"] and d["texts"][2]["label"] == "caption"
    d, _ = run({"op": "splitPicture", "pictureRef": "#/pictures/0", "regions": [{"bbox": 1}, {"bbox": 2, "caption": "c"}]})
    assert d["body"]["children"] == ["#/texts/0", "#/pictures/1", "#/pictures/2", "#/texts/1"] and d["pictures"][1]["captions"] == ["#/texts/1"]
    d, _ = run({"op": "updateTextRole", "textRef": "#/texts/0", "label": "page_header"}, {"op": "moveNode", "sourceRef": "#/texts/1", "targetRef": "#/pictures/0", "position": "before"})
    assert d["furniture"]["children"] == ["#/texts/0"] and d["body"]["children"] == ["#/texts/1", "#/pictures/0"]
    d, done = run({"op": "mergeTexts", "textRefs": ["#/texts/0", "#/texts/1"], "keepRef": "#/texts/0", "text": "ab"}, {"op": "updateTableCell", "tableRef": "#/tables/0", "row": 0, "col": 5, "text": ""})
    assert d["texts"][0]["text"] == "ab" and "#/texts/1" not in d["body"]["children"] and done[1].startswith("patch_skipped")
    d, _ = run({"op": "replaceTable", "tableRef": "#/tables/0", "grid": [[{"text": "1"}, {"text": "2"}]], "caption": "T"}, {"op": "updatePictureCaption", "pictureRef": "#/pictures/0", "caption": "P"})
    assert d["tables"][0]["num_cols"] == 2 and d["texts"][2]["text"] == "T" and d["texts"][1]["text"] == "P"
    d, done = run({"op": "addText", "pageNo": 1, "bbox": 0, "text": "n", "label": "text", "afterRef": "#/texts/0"}, {"op": "addPicture", "pageNo": 1, "bbox": 0, "imageUri": "u", "caption": "k"}, {"op": "hidePicture", "pictureRef": "#/pictures/0"},
                  {"op": "updateBbox", "targetRef": "#/texts/1", "bbox": 7}, {"op": "linkFootnote", "markerTextRef": "#/texts/0", "footnoteTextRef": "#/texts/1"}, {"op": "linkContinuedTable", "sourceTableRef": "#/tables/0", "continuedTableRef": "#/tables/0", "relation": "continues_on_next_page"})
    assert set(done) == {"applied", 'applied: {"previousBbox": 1}'} and d["body"]["children"] == ["#/texts/0", "#/texts/2", "#/texts/1", "#/pictures/1"] and d["texts"][1]["prov"][0]["bbox"] == 7 and len(d["links"]) == 2


def test_arbitration_by_lead(spark):
    d = spark.createDataFrame([(1, 1, 0.95, 1, "auto_applied"), (1, 2, 0.5, 2, "proposal"), (1, 3, 0.9, 3, "auto_applied"), (1, 4, 0.8, 4, "proposal")], "page long, id long, confidence double, seq long, disposition string")
    g = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 3), (1, 4, 3)], "page long, id long, root long")
    assert rows(review.arbitrated(d, g), "id", "disposition") == [(1, "auto_applied"), (3, "proposal"), (4, "proposal")]


def test_providers(spark):
    requests = spark.createDataFrame([(1, json.dumps({"key": "a", "text": "Fig. 3-1 x"})), (2, json.dumps({"key": "b", "text": "none"}))], "request_id long, request string")
    got = rows(providers.called(requests, providers.Replay({"a": {"num": "recorded"}}), providers.Rules(providers.caption_rule), retries=1), "request_id", "response", "model", "attempts")
    assert got == [(1, '{"num": "recorded"}', "replay", 1), (2, '{"num": null}', "rules", 3)]
    assert providers.page_number_rule({"text": "12\nbody\n- 13 -"}) == {"start": 13, "end": 13}
    with pytest.raises(ValueError):
        providers.batched(requests, 0, "request_id")


def test_raw_documents(spark, tmp_path):
    raw = {
        "schema_name": "s", "version": "1", "name": "n", "origin": {"mimetype": "m", "binary_hash": 18446744073709551615, "filename": "f"},
        "body": {"self_ref": "#/body", "children": [{"$ref": "#/texts/0"}, {"$ref": "#/tables/0"}]}, "furniture": {"self_ref": "#/furniture", "children": []}, "groups": [],
        "texts": [{"self_ref": "#/texts/0", "parent": {"$ref": "#/body"}, "label": "text", "prov": [{"page_no": 2}], "text": "Hello  there", "orig": "Hello"}, {"self_ref": "#/texts/1", "parent": {"$ref": "#/pictures/0"}, "label": "text", "text": "inside"}, {"self_ref": "#/texts/2", "label": "footnote", "text": "note"}],
        "pictures": [{"self_ref": "#/pictures/0", "captions": [{"$ref": "#/texts/0"}]}], "tables": [{"self_ref": "#/tables/0", "label": "table", "data": {"num_rows": 1, "num_cols": 1, "grid": [[{"text": "x", "start_row_offset_idx": 0, "start_col_offset_idx": 0}]]}}],
        "pages": {"2": {"page_no": 2, "size": {"width": 10, "height": 20}}},
    }
    (tmp_path / "d.json").write_text(json.dumps(raw, indent=1))
    df = src.read_documents(spark, f"file://{tmp_path}/d.json")
    assert str(df.first()["origin"]["binary_hash"]) == "18446744073709551615"
    assert rows(src.body_texts(df), "self_ref", "text", "page_no") == [("#/texts/0", "Hello there", 2)]
    assert rows(src.footnotes(df), "self_ref", "page_no") == [("#/texts/2", 1)]
    assert rows(src.pictures(df), "path", "page_no") == [("images/image_0.png", 0)]
    assert rows(src.grid_cells(df), "row", "col", "text") == [(0, 0, "x")]
    assert rows(src.page_table(df), "page_no", "width") == [(2, 10.0)]
    assert rows(src.edges(df), "parent_ref", "child_ref") == [("#/body", "#/tables/0"), ("#/body", "#/texts/0")]


def test_archives_and_images(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.json", "{}")
        z.writestr("x.html", '<img src="data:image/png;base64,aGk=">')
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("x.json", "{}")
    (tmp_path / "c.zip").write_bytes(b"no archive")
    got = {r["path"].rpartition("/")[2]: r for r in src.read_archives(spark, f"file://{tmp_path}/*.zip").collect()}
    assert got["a.zip"]["error"] is None and "html" in got["b.zip"]["error"] and got["c.zip"]["error"]
    html = spark.createDataFrame([(got["a.zip"]["html"] * 2,)], "t string")
    r = html.select(src.embedded_images(F.col("t")).alias("i"), src.with_image_files(F.col("t")).alias("w"), src.decoded(F.get(src.embedded_images(F.col("t")), F.lit(0))).alias("d")).first()
    assert r["i"] == ["aGk=", "aGk="] and "images/image_0.png" in r["w"] and "images/image_1.png" in r["w"] and bytes(r["d"]) == b"hi"
    assert len(src.manifest(spark, f"file://{tmp_path}/*.zip").collect()) == 3


def test_checkpoint_guard():
    assert src.read_checkpoint('{"version": 1, "run_id": "r", "completed": [1]}', "r")["completed"] == [1]
    for bad in (None, "{", '{"version": 2, "run_id": "r"}', '{"version": 1, "run_id": "other"}'):
        assert src.read_checkpoint(bad, "r")["completed"] == []


def test_queue():
    q = streams.Queue(2)
    q.restore([(1, "queued"), (2, "running"), (3, "queued")])
    assert q.start() == [2, 1] and q.start() == [] and q.position(3) == 1 and q.position(2) == 0
    q.finish(2)
    assert q.start() == [3] and q.cancel(3) and not q.cancel(9) and q.position(9) == -1


def test_uploads(spark):
    from docloom.operators import tasks

    c = spark.createDataFrame([("a", 1, 2, b"F-rest"), ("a", 0, 2, b"%PD"), ("b", 0, 2, b"x")], "session string, chunk int, total int, data binary")
    r = tasks.complete_uploads(c).collect()
    assert [(x["session"], bytes(x["data"]), x["is_pdf"]) for x in r] == [("a", b"%PDF-rest", True)]


def test_deep_trees(spark):
    """A chain of nodes deeper than any fixed number of levels, with a second child of the root; dangling nodes and a ring follow."""
    n = [(1, i, None if i == 0 else i - 1, 0) for i in range(25)] + [(1, 100, 0, 1), (1, 200, 999, 5), (1, 300, 301, 6), (1, 301, 300, 7)]
    df = spark.createDataFrame(n, "doc_id long, id long, parent long, ordinal long")
    assert [r["id"] for r in nodes.reading_order(df).orderBy("reading_order").collect()] == [*range(25), 100, 200, 300, 301]
    assert {r["id"]: r["level"] for r in chapters.subtree(df).collect()} == {**{i: i + 1 for i in range(25)}, 100: 2}
    up = [(1, "#/groups/0", None), *((1, f"#/texts/{i}", "#/groups/0" if i == 0 else f"#/texts/{i - 1}") for i in range(20)), (1, "#/texts/90", "#/texts/91"), (1, "#/texts/91", "#/texts/90"), (1, "#/texts/95", "#/texts/404")]
    got = {r["self_ref"]: r["container"] for r in nodes.nearest_container(spark.createDataFrame(up, "doc_id long, self_ref string, parent_ref string")).collect()}
    assert got == {f"#/texts/{i}": "#/groups/0" for i in range(20)}


def test_refused_commands_leave_no_trace():
    doc = {"texts": [{"self_ref": "#/texts/0", "text": "a", "orig": "a", "label": "text"}, {"self_ref": "#/texts/1", "text": "b", "label": "page_footer"}], "body": {"children": ["#/texts/0"]}, "furniture": {"children": ["#/texts/1"]}}
    bad = [{"op": "mergeTexts", "keepRef": "#/texts/0", "textRefs": ["#/texts/0", "#/texts/9"], "text": "x"}, {"op": "splitText", "textRef": "#/texts/0", "parts": [{"text": "p"}, {"text": "q"}, {}]}, {"op": "addText", "text": "t", "label": "text", "pageNo": 1, "bbox": 1, "afterRef": "#/texts/7"}, {"op": "moveNode", "sourceRef": "#/texts/0", "targetRef": "#/texts/1", "position": "after", "x": 1}]
    after, done = patch.apply_commands(doc, bad[:3])
    assert after == doc and all(x.startswith("patch_skipped") for x in done)
    after, _ = patch.apply_commands(doc, [{"op": "linkFootnote", "markerTextRef": "#/texts/0", "footnoteTextRef": "#/texts/1"}])
    assert after["body"]["children"] == ["#/texts/0", "#/texts/1"] and after["furniture"]["children"] == [] and after["texts"][1]["label"] == "footnote"
