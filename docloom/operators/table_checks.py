"""Corrections of tables judged against the table's neighbourhood.

``neighbourhoods`` joins each page's tables to one another and to those of the pages beside it; ``reasons`` are expressions over
a command and its table's row. Tables are doc_id, page, ref, has_box, caption, grid (rows of cells: text, row_span, col_span,
column_header, row_header), units, markers, footnote_refs. Missing lists count as empty ones, missing spans as 1, missing header
marks as false. A command whose table isn't known gets the reason of a missing target alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.functions import text as T
from docloom.operators.commands import _all, _none, _when

CELL = "struct<text:string,row_span:int,col_span:int,column_header:boolean,row_header:boolean>"
GRID = f"array<array<{CELL}>>"
#: A replacement may empty this share of cells more than the table had, a table has many empty cells from here on.
EMPTIED, MANY_EMPTY = 0.35, 0.5
#: Shorter texts of other tables prove nothing.
TOKEN, PREVIEW = 4, 8


def _plain(c: Column) -> Column:
    return T.spaceless(F.coalesce(c, F.lit("")), lower=True)


def _cells(grid: Column) -> Column:
    return F.flatten(F.coalesce(grid, F.array().cast(GRID)))


def empty_share(grid: Column) -> Column:
    """A7 of a grid."""
    cells = _cells(grid)
    return F.coalesce(F.try_divide(F.size(F.filter(cells, lambda c: T.trimmed(F.coalesce(c["text"], F.lit(""))) == "")), F.size(cells)), F.lit(0.0))


def _spanned(grid: Column) -> Column:
    return F.exists(_cells(grid), lambda c: (F.coalesce(c["row_span"], F.lit(1)) > 1) | (F.coalesce(c["col_span"], F.lit(1)) > 1))


def _headed(grid: Column, *marks: str) -> Column:
    return F.exists(_cells(grid), lambda c: F.greatest(*(F.coalesce(c[m], F.lit(False)) for m in (*marks, marks[0]))))


def tokens(caption: Column, grid: Column) -> Column:
    """A table's caption and the texts of its first rows and columns, in their plain forms."""
    seen = F.flatten(F.transform(F.slice(F.coalesce(grid, F.array().cast(GRID)), 1, PREVIEW), lambda r: F.transform(F.slice(r, 1, PREVIEW), lambda c: _plain(c["text"]))))
    return F.array_distinct(F.filter(F.concat(F.array(_plain(caption)), seen), lambda t: t != ""))


def neighbourhoods(tables: DataFrame) -> DataFrame:
    """Tables with their own tokens, what other tables of their page say that they don't, how many those are, the references on the pages before and after, and hints."""
    t = tables.withColumn("own", tokens(F.col("caption"), F.col("grid"))).withColumn("units", F.coalesce("units", _none())).withColumn("markers", F.coalesce("markers", _none()))
    page = t.groupBy("doc_id", "page").agg(F.collect_list(F.struct("ref", "own")).alias("all"))
    beside = lambda step, name: t.select("doc_id", (F.col("page") + step).alias("page"), F.col("ref").alias("r")).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("r")).alias(name))
    j = t.join(page, ["doc_id", "page"]).join(beside(1, "previous"), ["doc_id", "page"], "left").join(beside(-1, "following"), ["doc_id", "page"], "left")
    foreign = F.flatten(F.transform(F.filter("all", lambda x: x["ref"] != F.col("ref")), lambda x: F.filter(x["own"], lambda k: (F.length(k) >= TOKEN) & ~F.array_contains(F.col("own"), k))))
    j = j.withColumn("foreign", F.array_distinct(foreign)).withColumn("on_page", F.size("all")).withColumn("previous", F.coalesce("previous", _none())).withColumn("following", F.coalesce("following", _none())).drop("all")
    hints = _all(
        _when(F.col("on_page") > 1, "multiple_tables_on_page"), _when(~F.col("has_box"), "target_table_bbox_missing"), _when(_spanned(F.col("grid")), "span_cells_present"), _when(_headed(F.col("grid"), "column_header"), "column_headers_present"),
        _when(_headed(F.col("grid"), "row_header"), "row_headers_present"), _when(F.size("units") > 0, "unit_hints_present"), _when((F.size("markers") > 0) | (F.size(F.coalesce("footnote_refs", _none())) > 0), "footnote_hints_present"),
        _when(empty_share(F.col("grid")) >= MANY_EMPTY, "many_empty_cells_present"), _when(F.size("previous") + F.size("following") > 0, "continued_table_neighbors_present"),
    )
    return j.withColumn("hints", hints)


def _same(old: Column, new: Column) -> Column:
    """Whether a replacement says what the table says, cell by cell."""
    cell = lambda a, b: (
        (_plain(a["text"]) == _plain(b["text"])) & (F.coalesce(a["row_span"], F.lit(1)) == F.coalesce(b["row_span"], F.lit(1))) & (F.coalesce(a["col_span"], F.lit(1)) == F.coalesce(b["col_span"], F.lit(1)))
        & (F.coalesce(a["column_header"], F.lit(False)) == F.coalesce(b["column_header"], F.lit(False))) & (F.coalesce(a["row_header"], F.lit(False)) == F.coalesce(b["row_header"], F.lit(False)))
    )
    rows = F.zip_with(old, new, lambda r, s: (F.size(r) == F.size(s)) & F.forall(F.zip_with(r, s, lambda a, b: F.coalesce(cell(a, b), F.lit(False))), lambda x: x))
    return F.when(F.size(old) != F.size(new), F.lit(False)).otherwise(F.coalesce(F.forall(rows, lambda x: F.coalesce(x, F.lit(False))), F.lit(False)))


def _span_reasons(grid: Column) -> Column:
    rows, cols = F.size(grid), F.coalesce(F.size(F.get(grid, F.lit(0))), F.lit(0))

    def of(c: Column, i: Column, k: Column) -> Column:
        r, w = F.coalesce(c["row_span"], F.lit(1)), F.coalesce(c["col_span"], F.lit(1))
        return F.when((r < 1) | (w < 1), F.array(F.lit("table_correction_invalid_span"))).when((i + r > rows) | (k + w > cols), F.array(F.lit("table_correction_span_out_of_bounds"))).otherwise(_none())

    return F.flatten(F.flatten(F.transform(grid, lambda row, i: F.transform(row, lambda c, k: of(c, i, k)))))


def _mixed(text: Column) -> Column:
    said = _plain(text)
    return _when((said != "") & F.exists("foreign", lambda k: F.contains(said, k)), "table_correction_other_table_content_mixed")


def replacement_reasons(new: Column) -> Column:
    """What a replacement loses or brings in; a replacement by the same alone says so."""
    old = F.col("grid")
    said = F.array_join(F.transform(_cells(new), lambda c: F.coalesce(c["text"], F.lit(""))), "\n")
    token = lambda u: F.regexp_extract(u, fixed.UNIT_TOKEN, 0)
    lost_unit = F.exists("units", lambda u: (token(u) != "") & ~F.contains(_plain(said), _plain(token(u))))
    lost_marker = F.exists("markers", lambda m: ~F.contains(said, m))
    changed = _all(
        _span_reasons(new), _when(_spanned(old) & ~_spanned(new), "table_correction_span_metadata_dropped"), _when(_headed(old, "column_header", "row_header") & ~_headed(new, "column_header", "row_header"), "table_correction_header_metadata_dropped"),
        _when(lost_unit, "table_correction_unit_hint_dropped"), _when(lost_marker, "table_correction_footnote_marker_dropped"), _when(empty_share(new) - empty_share(old) > EMPTIED, "table_correction_empty_cell_explosion"), _mixed(said),
    )
    return F.when(_same(old, new), F.array(F.lit("table_correction_noop"))).otherwise(changed)


def judged(commands: DataFrame, tables: DataFrame) -> DataFrame:
    """Commands (doc_id, page, target, op, ref, other_ref, relation, text, new: a grid) with their reasons; ``tables`` are ``neighbourhoods``."""
    t = tables.select("doc_id", F.col("ref").alias("target"), "has_box", "grid", "units", "markers", "foreign", "on_page", "previous", "following", "hints")
    j = commands.join(t, ["doc_id", "target"], "left")
    op = F.col("op")
    strayed = _when(~F.col("ref").eqNullSafe(F.col("target")), "table_correction_target_ref_mismatch")
    turned = _all(
        _when((F.col("relation") == "continues_on_next_page") & ~F.coalesce(F.array_contains("following", F.col("other_ref")), F.lit(False)), "table_correction_continuation_ref_not_next_page"),
        _when((F.col("relation") == "continued_from_previous_page") & ~F.coalesce(F.array_contains("previous", F.col("other_ref")), F.lit(False)), "table_correction_continuation_ref_not_previous_page"),
    )
    rule = F.when(op == "updateTableCell", _mixed(F.col("text"))).when(op == "replaceTable", replacement_reasons(F.col("new"))).otherwise(turned)
    found = _all(_when((F.col("on_page") > 1) & ~F.col("has_box"), "table_correction_target_bbox_missing"), strayed, rule)
    why = F.when(~op.isin(*fixed.TABLE_OPS), F.array(F.concat(F.lit("table_correction_op_not_allowed:"), op))).when(F.col("on_page").isNull(), F.array(F.concat(F.lit("table_correction_target_ref_not_found:"), "target"))).otherwise(found)
    return j.withColumn("reasons", why)
