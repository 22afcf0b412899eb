"""V5: commands of a page's answer against the page: do their references exist, were they taken before, do the contents fit.

A page's context and its commands meet once, by document and page; the rules are expressions over both, and one fold over the
page's commands in their order carries what earlier valid ones have taken.

``contexts`` makes a row a page from blocks (doc_id, page, ord, ref, kind, text, suspect, rows, cols, preview, box, candidate,
orientation, suggested), pages (doc_id, page, width, height and the page's evidence) and neighbours (doc_id, page, ref).
Commands are doc_id, page, seq, answer_page, op, ref, other_ref, text_refs, text, parts, label, page_no, box, row, col, widths,
caption, regions; what an operation doesn't use is null. Of blocks with one reference the first counts. A page without blocks
knows no reference; a page without size has no outside. Missing lists count as empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed, geometry as G
from docloom.functions import text as T
from docloom.operators import context

BOX = "struct<l:double,t:double,r:double,b:double,coord_origin:string>"
BLOCK = f"struct<kind:string,chars:double,inked:double,suspect:array<string>,rows:bigint,cols:bigint,preview:array<int>,box:{BOX},candidate:boolean,orientation:string,suggested:int>"
EVIDENCE = ("missing", "warned", "footnotes", "reading", "visual")
FIELDS = ("seq", "answer_page", "op", "ref", "other_ref", "text_refs", "text", "parts", "label", "page_no", "box", "row", "col", "widths", "caption", "regions", "confidence")


def _none(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def _when(condition: Column, why: str) -> Column:
    return F.when(condition, F.array(F.lit(why))).otherwise(_none())


def _all(*lists: Column) -> Column:
    return F.concat(*lists)


def units(text: Column) -> Column:
    """A text's length in UTF-16 units."""
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def contexts(blocks: DataFrame, pages: DataFrame, neighbours: DataFrame) -> DataFrame:
    """doc_id, page, width, height, evidence lists, blocks by reference, and the references of tables on neighbouring pages.

    Of texts only their lengths are kept, with and without white space, as no rule asks for more; all three inputs meet in one grouping.
    """
    fields = ["kind", units(F.col("text")), units(T.spaceless(F.col("text"))), "suspect", "rows", "cols", "preview", "box", "candidate", "orientation", "suggested"]
    block, page, beside = F.struct("ref", "ord", F.struct(*fields).cast(BLOCK).alias("b")), F.struct(*(c for c in pages.columns if c not in ("doc_id", "page"))), F.col("ref")
    rows = (
        blocks.select("doc_id", "page", block.alias("block")).unionByName(pages.select("doc_id", "page", page.alias("seen")), True)
        .unionByName(neighbours.select("doc_id", "page", beside.alias("beside")), True)
    )
    met = rows.groupBy("doc_id", "page").agg(F.first("seen", True).alias("seen"), F.array_sort(F.collect_list("block")).alias("found"), F.collect_set("beside").alias("beside"))
    known = F.filter("found", lambda x, i: (i == 0) | (x["ref"] != F.get("found", i - 1)["ref"]))
    return met.where(F.col("seen").isNotNull() | (F.size("found") > 0)).select("doc_id", "page", "seen.*", F.map_from_entries(F.transform(known, lambda x: F.struct(x["ref"], x["b"]))).alias("blocks"), "beside")


def box_reasons(box: Column, width: Column, height: Column) -> Column:
    """What is wrong with a box on a page: not finite alone, else wrong orders, then the page's edges."""
    finite = F.lit(True)
    for side in "ltrb":
        finite = finite & F.coalesce(~F.isnan(box[side]) & (F.abs(box[side]) < float("inf")), F.lit(False))
    low, high = F.least(box["t"], box["b"]), F.greatest(box["t"], box["b"])
    up = F.coalesce(box["coord_origin"] == "BOTTOMLEFT", F.lit(False))
    top, bottom = F.when(up, height - high).otherwise(low), F.when(up, height - low).otherwise(high)
    outside = height.isNotNull() & F.coalesce((box["l"] < 0) | (top < 0) | (box["r"] > width) | (bottom > height), F.lit(False))
    ordered = _all(_when(box["r"] <= box["l"], "bbox_invalid_horizontal_order"), _when(high <= low, "bbox_invalid_vertical_order"), _when(outside, "bbox_outside_page"))
    return F.when(finite, ordered).otherwise(F.array(F.lit("bbox_non_finite")))


def _pair(regions: Column, fits) -> Column:
    """Whether two different regions fit."""
    numbered = F.transform(regions, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.exists(numbered, lambda a: F.exists(numbered, lambda b: (a["i"] < b["i"]) & fits(a["x"], b["x"])))


def _parted(regions: Column, upright: bool, height: Column) -> Column:
    """Whether two regions lie apart on one axis and share half of the shorter one's stretch on the other."""
    axis, across = ("x", "y") if upright else ("y", "x")

    def fits(p: Column, q: Column) -> Column:
        a, b = G.top_left(p, height), G.top_left(q, height)
        apart = (a[f"{axis}1"] <= b[f"{axis}0"]) | (b[f"{axis}1"] <= a[f"{axis}0"])
        return apart & (G.axis_overlap(a[f"{across}0"], a[f"{across}1"], b[f"{across}0"], b[f"{across}1"]) >= 0.5)

    return _pair(regions, fits)


def split_reasons(regions: Column, picture: Column, height: Column) -> Column:
    """What speaks against cutting a picture into these regions, boxes' own faults aside."""
    n = F.size(regions)
    tallest = F.coalesce(height, F.array_max(F.transform(regions, lambda r: F.greatest(r["t"], r["b"]))))
    overlap = _pair(regions, lambda a, b: G.iou(G.top_left(a), G.top_left(b)) > 0.5)
    within = lambda r: G.containment(G.top_left(r, F.coalesce(height, F.greatest(r["t"], r["b"], picture["box"]["t"], picture["box"]["b"]))), G.top_left(picture["box"], F.coalesce(height, F.greatest(r["t"], r["b"], picture["box"]["t"], picture["box"]["b"]))))
    upright, flat = _parted(regions, True, tallest), _parted(regions, False, tallest)
    way = picture["orientation"]
    bounded = F.when(way == "grid", (n >= 4) & upright & flat).when(way == "vertical", upright).when(way.isNotNull(), flat).otherwise(F.lit(True))
    suggested = F.coalesce(picture["suggested"], F.lit(0))
    held = _all(
        _when(F.exists(regions, lambda r: within(r) < 0.9), "split_picture_region_outside_source"), _when((suggested > 0) & (n != suggested), "split_picture_region_count_mismatch"),
        _when(~bounded, "split_picture_boundary_not_supported"),
    )
    source = (
        F.when(picture.isNull() | (picture["kind"] != "picture"), _none()).when(~F.coalesce(picture["candidate"], F.lit(False)), F.array(F.lit("split_picture_without_boundary_candidate")))
        .when(picture["box"].isNull(), F.array(F.lit("split_picture_source_bbox_missing"))).otherwise(held)
    )
    return _all(_when(n < 2, "split_picture_requires_multiple_regions"), _when(overlap, "split_picture_regions_overlap"), source)


class Page:
    """The rules of the sixteen operations over a command struct and its page's columns."""

    def __init__(self, c: Column):
        self.c, self.op = c, c["op"]
        self.width, self.height = F.col("width"), F.col("height")

    def block(self, ref: Column) -> Column:
        return F.try_element_at(F.col("blocks"), ref)

    def there(self, ref: Column, *kinds: str) -> Column:
        return F.coalesce(self.block(ref)["kind"].isin(*(kinds or ("text", "table", "picture"))), F.lit(False))

    def owned(self) -> Column:
        """The references that a command takes, and whether each exists as what the operation needs."""
        found = lambda ref: F.when(self.op.isin(*fixed.TEXT_OPS), self.there(ref, "text")).when(self.op.isin(*fixed.TABLE_OPS), self.there(ref, "table")).when(self.op.isin(*fixed.PICTURE_OPS), self.there(ref, "picture")).otherwise(self.there(ref))
        one = lambda ref: F.struct(ref.alias("ref"), found(ref).alias("there"))
        nothing = _none("struct<ref:string,there:boolean>")
        return F.when(self.op.isin("addText", "addPicture"), nothing).when(self.op == "linkFootnote", F.array(one(self.c["ref"]), one(self.c["other_ref"]))).otherwise(F.array(one(self.c["ref"])))

    def shape(self) -> Column:
        """What is wrong with a command by itself and its page, in the order of its operation's rules."""
        c, page = self.c, F.col("page")
        label = lambda field: _when(c["label"].isNull(), f"missing_required_field:{field}")
        texts = F.coalesce(c["text_refs"], _none())
        own, lacking = self.block(c["ref"]), lambda ref, kind: _when(~self.there(ref, kind), f"{kind}_ref_not_found")
        told, whole = F.when(own["kind"] == "text", own["chars"]), F.when(own["kind"] == "text", own["inked"])
        spoken = told > 0
        on_page = _when(F.coalesce(c["page_no"], page) != page, "page_number_mismatch")
        box = box_reasons(c["box"], self.width, self.height)
        joined = units(T.spaceless(F.array_join(F.coalesce(c["parts"], _none()), "")))
        widths, regions = F.coalesce(c["widths"], _none("int")), F.coalesce(c["regions"], _none(BOX))
        rows = F.coalesce(own["rows"], F.size(own["preview"]).cast("long"))
        cols = F.coalesce(own["cols"], F.get(own["preview"], c["row"].cast("int")).cast("long"), F.get(own["preview"], F.lit(0)).cast("long"), F.lit(0))
        suspect = F.when(own["kind"].isin("text", "table", "picture"), own["suspect"])
        kept = F.array_contains(texts, c["ref"])
        rules = {
            "replaceText": _when(spoken & (told > 20) & (units(F.coalesce(c["text"], F.lit(""))) < told * 0.3), "replacement_deletes_too_much_text"),
            "addText": _all(on_page, box, label("label")),
            "updateTextRole": label("label"),
            "removeText": _when(~F.coalesce(F.arrays_overlap(suspect, F.array(*map(F.lit, fixed.REMOVABLE))), F.lit(False)), "remove_text_without_deterministic_suspect_reason"),
            "mergeTexts": _all(F.flatten(F.transform(texts, lambda r: lacking(r, "text"))), F.when(kept, _none()).otherwise(_all(F.array(F.lit("merge_keep_ref_not_in_text_refs")), lacking(c["ref"], "text")))),
            "splitText": _when(spoken & ((joined < 0.5 * whole) | (joined > 1.5 * whole)), "split_text_parts_do_not_match_original_length"),
            "updateTableCell": F.when(own["kind"] == "table", F.when((c["row"] < 0) | (c["col"] < 0), F.array(F.lit("table_cell_negative_index"))).otherwise(_when((c["row"] >= rows) | (c["col"] >= cols), "table_cell_out_of_preview_range"))),
            "replaceTable": F.when(F.size(widths) == 0, F.array(F.lit("table_grid_empty"))).otherwise(_when((F.get(widths, F.lit(0)) == 0) | (F.array_min(widths) != F.array_max(widths)), "table_grid_not_rectangular")),
            "linkContinuedTable": _all(
                lacking(c["ref"], "table"), _when(~self.there(c["other_ref"], "table") & ~F.coalesce(F.array_contains("beside", c["other_ref"]), F.lit(False)), "table_ref_not_found"), label("relation")
            ),
            "updatePictureCaption": _all(_when(F.length(T.trimmed(c["caption"])) == 0, "caption_empty"), _when(units(c["caption"]) > context.CAPTION_CHARS, "caption_too_long")),
            "addPicture": _all(on_page, box),
            "splitPicture": _all(F.flatten(F.transform(regions, lambda r: box_reasons(r, self.width, self.height))), split_reasons(regions, own, self.height)),
            "updateBbox": _all(_when(~self.there(c["ref"]), "bbox_target_ref_not_found"), box),
            "linkFootnote": _all(lacking(c["ref"], "text"), lacking(c["other_ref"], "text")),
            "moveNode": _all(_when(~self.there(c["ref"]), "move_source_ref_not_found"), _when(~self.there(c["other_ref"]), "move_target_ref_not_found"), _when(F.coalesce(c["ref"] == c["other_ref"], F.lit(False)), "move_self_reference"), label("position")),
        }
        out = F.when(F.lit(False), _none())
        for name, found in rules.items():
            out = out.when(self.op == name, found)
        return F.coalesce(out, _none())

    def trusted(self) -> Column:
        """V7: misread ideographs, and texts that belong to a picture."""
        suspect = self.block(self.c["ref"])["suspect"]
        return F.coalesce(((self.op == "replaceText") & F.array_contains(suspect, "hanja_ocr_candidate")) | ((self.op == "removeText") & F.array_contains(suspect, "picture_internal_text")), F.lit(False))

    def evidenced(self) -> Column:
        """V7: whether the page shows what an operation claims."""
        c, reading, visual = self.c, F.col("reading"), F.col("visual")
        after = context.moved(reading, c["ref"], c["other_ref"], F.coalesce(c["label"] != "before", F.lit(True)))
        better = (context.order_mismatch(reading, visual) > 0) & (context.order_mismatch(after, visual) < context.order_mismatch(reading, visual))
        shown = (
            F.when(self.op == "addText", F.exists("missing", lambda m: T.spaceless(m) == T.spaceless(c["text"]))).when(self.op == "updateBbox", F.array_contains("warned", c["ref"]))
            .when(self.op == "linkFootnote", F.array_contains("footnotes", c["other_ref"])).when(self.op == "moveNode", (F.size(reading) > 0) & better)
        )
        return F.coalesce(shown, F.lit(False))


def validated(commands: DataFrame, contexts_: DataFrame, within: tuple[str, ...] = (), beside: DataFrame | None = None) -> DataFrame:
    """doc_id, page and every command with its reasons, whether it is valid, trusted and evidenced; in any order.

    ``within`` names columns that divide a page's commands into answers that don't know of each other; columns of ``beside``, a row a
    page, come along. Everything meets by document and page, so that what is partitioned by them once stays so.
    """
    fields = [c for c in FIELDS if c in commands.columns]
    answers = commands.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(F.struct(F.lit(0).alias("all"), *within).alias("answer"), *fields))).alias("commands"))
    j = answers.join(contexts_, ["doc_id", "page"], "left")
    more = [c for c in beside.columns if c not in ("doc_id", "page")] if beside is not None else []
    if more:
        j = j.join(beside, ["doc_id", "page"], "left")
    for c in EVIDENCE:
        j = j.withColumn(c, F.coalesce(F.col(c).cast("array<string>") if c in contexts_.columns else _none(), _none()))
    rules = lambda c: Page(c)
    read = j.withColumn("read", F.transform("commands", lambda c: F.struct(c.alias("c"), rules(c).owned().alias("owned"), rules(c).shape().alias("shape"), rules(c).trusted().alias("trusted"), rules(c).evidenced().alias("evidenced"), (c["answer_page"] == F.col("page")).alias("on_page"))))

    def step(acc: Column, x: Column) -> Column:
        taken = F.when(acc["answer"] == x["c"]["answer"], acc["taken"]).otherwise(_none())
        own = F.flatten(F.transform(x["owned"], lambda r: _all(_when(~r["there"], "target_ref_not_found"), _when(F.array_contains(taken, F.coalesce(r["ref"], F.lit(""))), "target_already_modified"))))
        reasons = _all(own, x["shape"])
        ok = (F.size(reasons) == 0) & x["on_page"]
        refs = F.transform(x["owned"], lambda r: r["ref"])
        return F.struct(x["c"]["answer"].alias("answer"), F.when(ok, F.array_union(taken, refs)).otherwise(taken).alias("taken"), F.concat(acc["out"], F.array(_all(_when(~x["on_page"], "page_number_mismatch"), reasons))).alias("out"))

    start = F.struct(F.get("commands", F.lit(0))["answer"].alias("answer"), _none().alias("taken"), _none("array<string>").alias("out"))
    folded = read.withColumn("reasons", F.aggregate("read", start, step, lambda acc: acc["out"]))
    each = folded.select("doc_id", "page", *more, F.explode(F.arrays_zip("read", "reasons")).alias("z"))
    return each.select("doc_id", "page", *(F.col(f"z.read.c.answer.{w}").alias(w) for w in within), *(F.col(f"z.read.c.{f}").alias(f) for f in fields), "z.reasons", (F.size("z.reasons") == 0).alias("valid"), F.col("z.read.trusted").alias("trusted"), F.col("z.read.evidenced").alias("evidenced"), *more)
