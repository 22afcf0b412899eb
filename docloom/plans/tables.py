"""Corrections of tables against their pages: two tables on every other page, commands for each that break every rule somewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.operators import items as I, table_checks as K
from docloom.plans.commands import Duck, Spark
from docloom.plans.context import lines

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
OPS = (*fixed.TABLE_OPS, "removeText")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _cell(d, text: str, rows="1", cols="1", column="FALSE", row="FALSE") -> str:
    if d is Spark:
        return f"named_struct('text', {text}, 'row_span', cast({rows} AS int), 'col_span', cast({cols} AS int), 'column_header', {column}, 'row_header', {row})"
    return f"{{'text': {text}, 'row_span': ({rows})::INT, 'col_span': ({cols})::INT, 'column_header': {column}, 'row_header': {row}}}"


def _old(d, k: str) -> str:
    """The grid of table k of a page: a header, a cell with a unit, empty cells on some pages."""
    head = d.array(_cell(d, f"'Head ' || {k}", "1", "CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END", "page_no % 2 = 0", "page_no % 3 = 0"), _cell(d, "'Size (cm)'", column="page_no % 2 = 0"))
    body = d.array(_cell(d, f"'Item' || page_no || 'of' || {k}"), _cell(d, "CASE WHEN (doc_id + page_no) % 5 = 0 THEN ' ' ELSE '10 cm *' END"))
    return d.array(head, body)


def _new(d, k: str) -> str:
    other = f"(1 - {k})"
    row = lambda *c: d.array(*c)
    cases = [
        _old(d, k),
        d.array(row(_cell(d, f"'head' || {k}"), _cell(d, "'Size (CM)'")), row(_cell(d, f"'Item ' || page_no || ' of' || {k} || '!'"), _cell(d, "'12 cm *'"))),
        d.array(row(_cell(d, "''"), _cell(d, "' '")), row(_cell(d, "''"), _cell(d, "'x'"))),
        d.array(row(_cell(d, "'a'", "0", "1", "TRUE"), _cell(d, "'b cm *'", "1", "2")), row(_cell(d, "'c'", "2", "1"), _cell(d, "'d'"))),
        d.array(row(_cell(d, f"'Item' || page_no || 'of' || {other}", "1", "2", "TRUE"), _cell(d, "'cm'"))),
    ]
    return f"CASE (doc_id + pos) % 5 {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(cases))} END"


def _tables(d, k: int) -> list[str]:
    one = lambda cond, x: f"CASE WHEN {cond} THEN {d.array(x)} ELSE {d.none('string')} END"
    return [
        "doc_id", "page_no AS page", f"'#/tables/' || (page_no * 2 + {k}) AS ref", f"(doc_id + page_no + {k}) % 3 <> 0 AS has_box", "CASE WHEN page_no % 4 = 0 THEN 'Table  ' || page_no END AS caption", f"{_old(d, str(k))} AS grid", one("page_no % 2 = 1", "'10 cm'") + " AS units", one("page_no % 3 = 1", "'*'") + " AS markers",
        f"{d.none('string')} AS footnote_refs",
    ]


def _commands(d) -> list[str]:
    k, op = "(pos % 2)", d.pick(d.array(*(f"'{o}'" for o in OPS)), f"(pos * 3 + doc_id) % {len(OPS)}")
    at = lambda p, t: f"'#/tables/' || ({p} * 2 + {t})"
    return [
        "doc_id", "page_no AS page", "pos", f"{at('page_no', k)} AS target", f"{op} AS op", f"CASE WHEN pos % 7 = 6 THEN {at('page_no', '1 - ' + k)} ELSE {at('page_no', k)} END AS ref", f"{at('(page_no - 1 + pos % 3)', '0')} AS other_ref",
        "CASE pos % 4 WHEN 0 THEN 'continues_on_next_page' WHEN 1 THEN 'continued_from_previous_page' WHEN 2 THEN 'same_table' END AS relation", "CASE pos % 3 WHEN 0 THEN 'ITEM' || page_no || ' of ' || (1 - pos % 2) ELSE text END AS text", f"{_new(d, k)} AS new",
    ]


def found(spark, sf_dir):
    l = lines(spark, sf_dir)
    pages = l.select("doc_id", "page_no").distinct()
    tables = pages.selectExpr(*_tables(Spark, 0)).unionByName(pages.where("(doc_id + page_no) % 2 = 0").selectExpr(*_tables(Spark, 1)))
    return K.judged(l.selectExpr(*_commands(Spark)), K.neighbourhoods(tables))


_P = lambda x: f"lower(regexp_replace({x}, '\\s+', '', 'g'))"
_W = lambda cond, why: f"(CASE WHEN {cond} THEN ['{why}'] ELSE [] END)"
_SPAN = lambda g: f"len(list_filter(flatten({g}), lambda c: c.row_span > 1 OR c.col_span > 1)) > 0"
_HEAD = lambda g: f"len(list_filter(flatten({g}), lambda c: c.column_header OR c.row_header)) > 0"
_BLANK = lambda g: f"(len(list_filter(flatten({g}), lambda c: trim(c.text) = '')) / len(flatten({g})))"
_SAID = f"array_to_string(list_transform(flatten(new), lambda c: c.text), chr(10))"
_MIX = lambda x: _W(f"{_P(x)} <> '' AND len(list_filter(foreign_tokens, lambda k: contains({_P(x)}, k))) > 0", "table_correction_other_table_content_mixed")
_JUDGED = f"""{I.ITEMS_SQL}, pg AS (SELECT DISTINCT doc_id, page_no FROM items), t0 AS (SELECT {', '.join(_tables(Duck, 0))} FROM pg UNION ALL SELECT {', '.join(_tables(Duck, 1))} FROM pg WHERE (doc_id + page_no) % 2 = 0),
tk AS (SELECT doc_id, page, ref, unnest([coalesce(caption, '')] || list_transform(flatten(grid), lambda c: c.text)) AS k FROM t0), pk AS (SELECT DISTINCT doc_id, page, ref, {_P('k')} AS k FROM tk WHERE trim(k) <> ''),
fr AS (SELECT t.doc_id, t.ref, list(DISTINCT o.k) FILTER (o.k IS NOT NULL) AS foreign_tokens FROM t0 t LEFT JOIN pk o ON o.doc_id = t.doc_id AND o.page = t.page AND o.ref <> t.ref AND length(o.k) >= 4 AND NOT EXISTS (SELECT 1 FROM pk m WHERE m.doc_id = t.doc_id AND m.ref = t.ref AND m.k = o.k) GROUP BY ALL),
nb AS (SELECT t.doc_id, t.ref, count(*) FILTER (o.page = t.page) AS on_page, list(o.ref) FILTER (o.page = t.page - 1) AS prev, list(o.ref) FILTER (o.page = t.page + 1) AS next FROM t0 t JOIN t0 o ON o.doc_id = t.doc_id AND abs(o.page - t.page) <= 1 GROUP BY ALL),
tt AS (SELECT t.*, coalesce(fr.foreign_tokens, []) AS foreign_tokens, nb.on_page, coalesce(nb.prev, []) AS prev, coalesce(nb.next, []) AS next FROM t0 t JOIN fr USING (doc_id, ref) JOIN nb USING (doc_id, ref)),
cm AS (SELECT {', '.join(_commands(Duck))} FROM items), j AS (SELECT c.*, (c.doc_id + c.pos) % 5 AS kind, t.ref AS known, t.has_box, t.grid, t.units, t.markers, t.foreign_tokens, t.on_page, t.prev, t.next FROM cm c LEFT JOIN tt t ON t.doc_id = c.doc_id AND t.ref = c.target)
SELECT doc_id, pos, op, array_to_string(CASE WHEN op = 'removeText' THEN ['table_correction_op_not_allowed:removeText'] WHEN known IS NULL THEN ['table_correction_target_ref_not_found:' || target] ELSE {_W("on_page > 1 AND NOT has_box", "table_correction_target_bbox_missing")} || {_W("ref <> target", "table_correction_target_ref_mismatch")}
 || CASE op WHEN 'updateTableCell' THEN {_MIX('text')} WHEN 'linkContinuedTable' THEN {_W("relation = 'continues_on_next_page' AND NOT list_contains(next, other_ref)", "table_correction_continuation_ref_not_next_page")} || {_W("relation = 'continued_from_previous_page' AND NOT list_contains(prev, other_ref)", "table_correction_continuation_ref_not_previous_page")}
 ELSE CASE WHEN kind = 0 THEN ['table_correction_noop'] ELSE CASE kind WHEN 3 THEN ['table_correction_invalid_span', 'table_correction_span_out_of_bounds', 'table_correction_span_out_of_bounds'] ELSE [] END || {_W(f"{_SPAN('grid')} AND NOT {_SPAN('new')}", "table_correction_span_metadata_dropped")} || {_W(f"{_HEAD('grid')} AND NOT {_HEAD('new')}", "table_correction_header_metadata_dropped")}
 || {_W(f"len(units) > 0 AND NOT contains({_P(_SAID)}, 'cm')", "table_correction_unit_hint_dropped")} || {_W(f"len(markers) > 0 AND NOT contains({_SAID}, '*')", "table_correction_footnote_marker_dropped")} || {_W(f"{_BLANK('new')} - {_BLANK('grid')} > 0.35", "table_correction_empty_cell_explosion")} || {_MIX(_SAID)} END END END, ',') AS reasons FROM j"""


@query(f"WITH {_JUDGED}")
def table_corrections(spark, sf_dir):
    """T19."""
    return found(spark, sf_dir).select("doc_id", "pos", "op", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {_JUDGED.split('cm AS (')[0].rstrip().rstrip(',')} SELECT doc_id, ref, array_to_string({_W("on_page > 1", "multiple_tables_on_page")} || {_W("NOT has_box", "target_table_bbox_missing")} || {_W(_SPAN('grid'), "span_cells_present")} || {_W("page % 2 = 0", "column_headers_present")} || {_W("page % 3 = 0", "row_headers_present")} || {_W("page % 2 = 1", "unit_hints_present")}
 || {_W("page % 3 = 1", "footnote_hints_present")} || {_W(_BLANK('grid') + " >= 0.5", "many_empty_cells_present")} || {_W("len(prev) + len(next) > 0", "continued_table_neighbors_present")}, ',') AS hints FROM tt""")
def table_hints(spark, sf_dir):
    """T22."""
    pages = lines(spark, sf_dir).select("doc_id", "page_no").distinct()
    tables = pages.selectExpr(*_tables(Spark, 0)).unionByName(pages.where("(doc_id + page_no) % 2 = 0").selectExpr(*_tables(Spark, 1)))
    return K.neighbourhoods(tables).select("doc_id", "ref", F.array_join("hints", ",").alias("hints"))
