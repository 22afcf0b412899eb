"""Commands of all sixteen operations against pages of the documents, validated, re-asked and ruled on.

Every line brings two commands against its page of three lines, a table and a picture; what they name and say follows from
counters, so that every rule meets rows that break it. The projection is one list of expressions for both engines; the rules in
SQL are written from the rules' description, with a recursion over a page's commands for what earlier ones have taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.operators import commands as V, context as C, items as I, review_run
from docloom.plans.documents import WS_SQL, WSZ_SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


OPS = tuple(dict.fromkeys(op for ops in fixed.TASK_OPS.values() for op in ops))


class Spark:
    array = staticmethod(lambda *x: f"array({', '.join(x)})")
    none = staticmethod(lambda kind: f"cast(array() AS array<{kind}>)")
    half = staticmethod(lambda a, b: f"({a} div {b})")
    pick = staticmethod(lambda a, i: f"element_at({a}, cast({i} + 1 AS int))")
    big = "bigint"
    box = staticmethod(lambda l, t, r, b, o: f"named_struct('l', cast({l} AS double), 't', cast({t} AS double), 'r', cast({r} AS double), 'b', cast({b} AS double), 'coord_origin', {o})")
    times = staticmethod(lambda s, n: f"repeat({s}, cast({n} AS int))")


class Duck:
    array = staticmethod(lambda *x: f"[{', '.join(x)}]")
    none = staticmethod(lambda kind: f"[]::{ {'string': 'VARCHAR', 'int': 'INT'}[kind] }[]")
    half = staticmethod(lambda a, b: f"({a} // {b})")
    pick = staticmethod(lambda a, i: f"({a})[{i} + 1]")
    big = "BIGINT"
    box = staticmethod(lambda l, t, r, b, o: f"{{'l': ({l})::DOUBLE, 't': ({t})::DOUBLE, 'r': ({r})::DOUBLE, 'b': ({b})::DOUBLE, 'coord_origin': {o}}}")
    times = staticmethod(lambda s, n: f"repeat({s}, ({n})::INT)")


def _command(d, half: int | str) -> list[str]:
    """A line's command as expressions; n counts variety."""
    n = f"(doc_id * 31 + pos * 7 + {half} * 3)"
    v = d.half(n, 16)
    first, op = "((page_no - 1) * 3)", d.pick(d.array(*(f"'{o}'" for o in OPS)), f"{n} % 16")
    text = lambda k: f"'#/texts/' || ({first} + {k} % 4)"
    own = f"CASE WHEN {op} IN {fixed.TABLE_OPS} THEN '#/tables/' || (page_no + CASE WHEN {v} % 7 = 6 THEN 500 ELSE 0 END) WHEN {op} IN {fixed.PICTURE_OPS} THEN '#/pictures/' || (page_no + CASE WHEN {v} % 7 = 6 THEN 500 ELSE 0 END) ELSE {text(f'({n} + {v})')} END"
    A, B, Cc, E = (d.box(*x, "'TOPLEFT'") for x in ((10, 10, 45, 70), (50, 10, 90, 70), (12, 10, 46, 70), (10, 45, 90, 70)))
    quarter = [d.box(*x, "'TOPLEFT'") for x in ((10, 10, 40, 30), (50, 10, 90, 30), (10, 40, 40, 70), (50, 40, 90, 70))]
    wrong = d.box(95, 10, 120, 70, "'TOPLEFT'")
    regions = f"CASE {v} % 7 WHEN 0 THEN {d.array(A, B)} WHEN 1 THEN {d.array(A, Cc)} WHEN 2 THEN {d.array(*quarter)} WHEN 3 THEN {d.array(A)} WHEN 4 THEN {d.array(A, wrong)} WHEN 5 THEN {d.array(A, B)} ELSE {d.array(d.box(10, 10, 90, 40, chr(39) + 'TOPLEFT' + chr(39)), E)} END"
    box = d.box(f"CASE WHEN {v} % 11 = 0 THEN NULL ELSE {n} % 90 - 3 END", f"{v} % 50 - 1", f"({n} * 7) % 105 + 5", f"({n} * 3) % 85", f"CASE WHEN {v} % 4 = 3 THEN 'BOTTOMLEFT' ELSE 'TOPLEFT' END")
    return [
        "doc_id", "page_no AS page", f"pos * 2 + {half} AS seq", "CASE WHEN doc_id % 13 = 5 AND page_no % 3 = 1 THEN page_no + 1 ELSE page_no END AS answer_page", f"{op} AS op", f"{own} AS ref",
        f"CASE WHEN {op} = 'linkContinuedTable' THEN '#/tables/' || (page_no + {v} % 4 - 1) ELSE {text(f'({v} + 1)')} END AS other_ref", f"{d.array(text('0'), text('1'), text(v))} AS text_refs",
        f"{d.times(chr(39) + 'w' + chr(39), f'{v} % 12')} AS text", f"{d.array(d.times(chr(39) + 'x' + chr(39), f'{v} % 60'), d.times(chr(39) + 'y ' + chr(39), f'{v} % 50'))} AS parts",
        f"CASE WHEN {v} % 5 = 0 THEN NULL WHEN {v} % 2 = 0 THEN 'before' ELSE 'after' END AS label", f"CASE WHEN {v} % 6 = 5 THEN page_no + 1 WHEN {v} % 6 = 4 THEN NULL ELSE page_no END AS page_no", f"{box} AS box", f"{v} % 6 - 1 AS row", f"{d.half(v, 6)} % 5 - 1 AS col",
        f"CASE {v} % 5 WHEN 0 THEN {d.none('int')} WHEN 1 THEN {d.array('2', '2')} WHEN 2 THEN {d.array('2', '3')} WHEN 3 THEN {d.array('0', '0')} ELSE {d.array('4')} END AS widths",
        f"{d.times(f'CASE WHEN {v} % 3 = 0 THEN {chr(39)} {chr(39)} ELSE {chr(39)}c{chr(39)} END', f'({v} * 13) % 260')} AS caption", f"{regions} AS regions", f"(({n} * 37) % 101) / 100.0E0 AS confidence",
    ]


def _blocks(d) -> dict[str, list[str]]:
    """Texts, tables and pictures of pages (doc_id, page_no) as blocks; lines for the first."""
    no_box = d.box("NULL", "NULL", "NULL", "NULL", "CAST(NULL AS VARCHAR(9))").join(("CASE WHEN 1 = 1 THEN NULL ELSE ", " END"))
    rest = lambda rows, cols, preview, box, candidate, way, n: [f"CAST({rows} AS {d.big}) AS rows", f"CAST({cols} AS {d.big}) AS cols", f"{preview} AS preview", f"{box} AS box", f"{candidate} AS candidate", f"{way} AS orientation", f"CAST({n} AS INT) AS suggested"]
    empty, nothing, arr = d.none("string"), d.none("int"), d.array
    suspect = f"CASE pos % 5 WHEN 0 THEN {arr(chr(39) + 'empty_text' + chr(39))} WHEN 1 THEN {arr(chr(39) + 'ocr_noise' + chr(39), chr(39) + 'picture_internal_text' + chr(39))} WHEN 2 THEN {arr(chr(39) + 'hanja_ocr_candidate' + chr(39))} ELSE {empty} END"
    picture = f"CASE WHEN page_no % 7 = 0 THEN NULL ELSE {d.box(10, 10, 90, 70, chr(39) + 'TOPLEFT' + chr(39))} END"
    return {
        "texts": ["doc_id", "page_no AS page", "pos AS ord", "self_ref AS ref", "'text' AS kind", "CASE WHEN pos % 6 = 5 THEN '' ELSE text END AS text", f"{suspect} AS suspect", *rest("NULL", "NULL", nothing, no_box, "CAST(NULL AS BOOLEAN)", "CAST(NULL AS VARCHAR(9))", "NULL")],
        "tables": ["doc_id", "page_no AS page", "1000000 AS ord", "'#/tables/' || page_no AS ref", "'table' AS kind", "'' AS text", f"{empty} AS suspect", *rest("CASE WHEN page_no % 5 = 0 THEN NULL ELSE page_no % 4 + 1 END", "CASE WHEN page_no % 2 = 0 THEN NULL ELSE 3 END", arr("2", "3"), no_box, "CAST(NULL AS BOOLEAN)", "CAST(NULL AS VARCHAR(9))", "NULL")],
        "pictures": ["doc_id", "page_no AS page", "2000000 AS ord", "'#/pictures/' || page_no AS ref", "'picture' AS kind", "'' AS text", f"{empty} AS suspect", *rest("NULL", "NULL", nothing, picture, "page_no % 3 <> 0", "CASE doc_id % 4 WHEN 0 THEN 'horizontal' WHEN 1 THEN 'vertical' WHEN 2 THEN 'grid' END", "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 2 ELSE 4 END")],
    }


_HAS = {"tables": "(doc_id + page_no) % 3 <> 0", "pictures": "(doc_id + page_no) % 4 <> 0"}


def lines(spark, sf_dir) -> DataFrame:
    return I.items(I.read(spark, sf_dir, "documents"))


def commands_of(items: DataFrame) -> DataFrame:
    return items.select("doc_id", "pos", "page_no", F.explode(F.array(F.lit(0), F.lit(1))).alias("half")).selectExpr(*_command(Spark, "half"))


def contexts_of(items: DataFrame) -> DataFrame:
    """Pages with their blocks, sizes, neighbours' tables and evidence."""
    b = _blocks(Spark)
    pages = items.select("doc_id", "page_no").distinct()
    tables = pages.where(_HAS["tables"])
    blocks = items.selectExpr(*b["texts"]).unionByName(tables.selectExpr(*b["tables"])).unionByName(pages.where(_HAS["pictures"]).selectExpr(*b["pictures"]))
    beside = tables.select("doc_id", F.col("page_no").alias("at")).crossJoin(F.broadcast(items.sparkSession.createDataFrame([(-1,), (1,)], "d long"))).select("doc_id", (F.col("at") + F.col("d")).alias("page"), F.concat(F.lit("#/tables/"), "at").alias("ref"))
    beside = beside.join(tables.select("doc_id", F.col("page_no").alias("page")), ["doc_id", "page"], "left_semi")
    sized = F.col("page_no") * 0 + F.when((F.col("doc_id") + F.col("page_no")) % 6 != 0, 1.0)
    refs = lambda *k: F.array(*(F.concat(F.lit("#/texts/"), ((F.col("page_no") - 1) * 3 + i).cast("string")) for i in k))
    seen = pages.select("doc_id", F.col("page_no").alias("page"), (sized * 100).alias("width"), (sized * 80).alias("height"), refs(0, 1, 2).alias("reading"), refs(1, 0, 2).alias("visual"), refs(0).alias("warned"), refs(2).alias("footnotes"), F.array(F.lit("w w"), F.lit("www")).alias("missing"))
    return V.contexts(blocks, seen, beside)


_S = lambda x: f"length(regexp_replace({x}, '{WS_SQL}+', '', 'g'))"
_BR = lambda b: f"CASE WHEN {b}.l IS NULL THEN ['bbox_non_finite'] ELSE (CASE WHEN {b}.r <= {b}.l THEN ['bbox_invalid_horizontal_order'] ELSE [] END) || (CASE WHEN {b}.t = {b}.b THEN ['bbox_invalid_vertical_order'] ELSE [] END) || (CASE WHEN width IS NOT NULL AND ({b}.l < 0 OR {b}.r > width OR CASE WHEN {b}.coord_origin = 'BOTTOMLEFT' THEN height - greatest({b}.t, {b}.b) < 0 OR height - least({b}.t, {b}.b) > height ELSE least({b}.t, {b}.b) < 0 OR greatest({b}.t, {b}.b) > height END) THEN ['bbox_outside_page'] ELSE [] END) END"
_W = lambda cond, why: f"(CASE WHEN {cond} THEN ['{why}'] ELSE [] END)"
_IN = lambda ref, *kinds: f"coalesce(list_contains([{', '.join(chr(39) + k + chr(39) for k in kinds)}], blocks[{ref}].kind), false)"
_ANY = ("text", "table", "picture")
#: Regions by the projection's seven shapes: overlapping, apart upright, apart flat, all within the picture.
_OVER, _UPRIGHT, _FLAT, _INSIDE, _COUNT = "(k = 1)", "(k IN (0, 2, 4, 5))", "(k IN (2, 6))", "(k <> 4)", "CASE k WHEN 2 THEN 4 WHEN 3 THEN 1 ELSE 2 END"
_SHAPE = f"""CASE op
 WHEN 'replaceText' THEN {_W("own.kind = 'text' AND length(own.text) > 20 AND length(text) < 0.3 * length(own.text)", "replacement_deletes_too_much_text")}
 WHEN 'addText' THEN {_W("coalesce(page_no, page) <> page", "page_number_mismatch")} || {_BR("box")} || {_W("label IS NULL", "missing_required_field:label")}
 WHEN 'updateTextRole' THEN {_W("label IS NULL", "missing_required_field:label")}
 WHEN 'removeText' THEN {_W("NOT coalesce(list_has_any(own.suspect, ['empty_text', 'ocr_noise', 'picture_internal_text']), false)", "remove_text_without_deterministic_suspect_reason")}
 WHEN 'mergeTexts' THEN list_transform(list_filter(text_refs, lambda r: NOT {_IN("r", "text")}), lambda r: 'text_ref_not_found') || CASE WHEN list_contains(text_refs, ref) THEN [] ELSE ['merge_keep_ref_not_in_text_refs'] || {_W("NOT " + _IN("ref", "text"), "text_ref_not_found")} END
 WHEN 'splitText' THEN {_W(f"own.kind = 'text' AND length(own.text) > 0 AND ({_S('parts[1] || parts[2]')} < 0.5 * {_S('own.text')} OR {_S('parts[1] || parts[2]')} > 1.5 * {_S('own.text')})", "split_text_parts_do_not_match_original_length")}
 WHEN 'updateTableCell' THEN CASE WHEN own.kind <> 'table' OR own IS NULL THEN [] WHEN row < 0 OR col < 0 THEN ['table_cell_negative_index'] ELSE {_W("row >= coalesce(own.rows, 2) OR col >= coalesce(own.cols, CASE WHEN row = 1 THEN 3 ELSE 2 END)", "table_cell_out_of_preview_range")} END
 WHEN 'replaceTable' THEN CASE WHEN len(widths) = 0 THEN ['table_grid_empty'] ELSE {_W("widths[1] = 0 OR len(list_distinct(widths)) > 1", "table_grid_not_rectangular")} END
 WHEN 'linkContinuedTable' THEN {_W("NOT " + _IN("ref", "table"), "table_ref_not_found")} || {_W("NOT " + _IN("other_ref", "table") + " AND NOT list_contains(beside, other_ref)", "table_ref_not_found")} || {_W("label IS NULL", "missing_required_field:relation")}
 WHEN 'updatePictureCaption' THEN {_W("trim(caption) = ''", "caption_empty")} || {_W("length(caption) > 240", "caption_too_long")}
 WHEN 'addPicture' THEN {_W("coalesce(page_no, page) <> page", "page_number_mismatch")} || {_BR("box")}
 WHEN 'splitPicture' THEN flatten(list_transform(regions, lambda b: {_BR("b")})) || {_W(_COUNT + " < 2", "split_picture_requires_multiple_regions")} || {_W(_OVER, "split_picture_regions_overlap")} || CASE WHEN own IS NULL OR own.kind <> 'picture' THEN [] WHEN NOT own.candidate THEN ['split_picture_without_boundary_candidate'] WHEN own.box IS NULL THEN ['split_picture_source_bbox_missing']
   ELSE {_W("NOT " + _INSIDE, "split_picture_region_outside_source")} || {_W(f"coalesce(own.suggested, {_COUNT}) <> {_COUNT}", "split_picture_region_count_mismatch")} || {_W(f"CASE own.orientation WHEN 'vertical' THEN NOT {_UPRIGHT} WHEN 'horizontal' THEN NOT {_FLAT} WHEN 'grid' THEN k <> 2 ELSE false END", "split_picture_boundary_not_supported")} END
 WHEN 'updateBbox' THEN {_W("NOT " + _IN("ref", *_ANY), "bbox_target_ref_not_found")} || {_BR("box")}
 WHEN 'linkFootnote' THEN {_W("NOT " + _IN("ref", "text"), "text_ref_not_found")} || {_W("NOT " + _IN("other_ref", "text"), "text_ref_not_found")}
 WHEN 'moveNode' THEN {_W("NOT " + _IN("ref", *_ANY), "move_source_ref_not_found")} || {_W("NOT " + _IN("other_ref", *_ANY), "move_target_ref_not_found")} || {_W("ref = other_ref", "move_self_reference")} || {_W("label IS NULL", "missing_required_field:position")}
 ELSE [] END"""
_B = _blocks(Duck)
PAGES_SQL = f"""{I.ITEMS_SQL}, pg AS (SELECT DISTINCT doc_id, page_no FROM items),
blk AS (SELECT {', '.join(_B['texts'])} FROM items UNION ALL SELECT {', '.join(_B['tables'])} FROM pg WHERE {_HAS['tables']} UNION ALL SELECT {', '.join(_B['pictures'])} FROM pg WHERE {_HAS['pictures']}),
ctx AS (SELECT doc_id, page, CASE WHEN (doc_id + page) % 6 <> 0 THEN 100.0::DOUBLE END AS width, CASE WHEN (doc_id + page) % 6 <> 0 THEN 80.0::DOUBLE END AS height,
 map_from_entries(list({{'k': ref, 'v': {{'kind': kind, 'text': text, 'suspect': suspect, 'rows': rows, 'cols': cols, 'box': box, 'candidate': candidate, 'orientation': orientation, 'suggested': suggested}}}})) AS blocks FROM blk GROUP BY doc_id, page),
nb AS (SELECT a.doc_id, a.page, list(b.ref) AS beside FROM blk a JOIN blk b ON a.doc_id = b.doc_id AND abs(a.page - b.page) = 1 AND a.kind = 'table' AND b.kind = 'table' GROUP BY ALL)"""


def ruled_sql(x: str, kept: str = "true", item: str = "0") -> str:
    """The commands that are ``kept`` with their reasons as ``ruled<x>``; those of one ``item`` know of each other."""
    return f"""cmd{x} AS (SELECT * FROM (SELECT {', '.join(_command(Duck, 0))} FROM items UNION ALL SELECT {', '.join(_command(Duck, 1))} FROM items) WHERE {kept}),
j{x} AS (SELECT c.*, x.width, x.height, x.blocks, coalesce(nb.beside, []) AS beside, x.blocks[c.ref] AS own, ((c.doc_id * 31 + (c.seq // 2) * 7 + (c.seq % 2) * 3) // 16) % 7 AS k FROM cmd{x} c JOIN ctx x USING (doc_id, page) LEFT JOIN nb USING (doc_id, page)),
st{x} AS (SELECT *, {_SHAPE} AS shape, CASE WHEN op IN ('addText', 'addPicture') THEN [] WHEN op = 'linkFootnote' THEN [ref, other_ref] ELSE [ref] END AS takes,
 list_transform(CASE WHEN op IN ('addText', 'addPicture') THEN [] WHEN op = 'linkFootnote' THEN [ref, other_ref] ELSE [ref] END, lambda r: CASE WHEN op IN {fixed.TEXT_OPS} THEN {_IN("r", "text")} WHEN op IN {fixed.TABLE_OPS} THEN {_IN("r", "table")} WHEN op IN {fixed.PICTURE_OPS} THEN {_IN("r", "picture")} ELSE {_IN("r", *_ANY)} END) AS there,
 answer_page = page AS on_page, row_number() OVER (PARTITION BY doc_id, page, {item} ORDER BY seq) AS nth FROM j{x}),
sm{x} AS (SELECT doc_id, page, {item} AS item, seq, op, nth, on_page, shape, takes, there FROM st{x}),
walk{x} AS (SELECT doc_id, page, item, 0::BIGINT AS nth, []::VARCHAR[] AS taken, NULL::BIGINT AS seq, ''::VARCHAR AS op, []::VARCHAR[] AS reasons FROM ctx, (SELECT unnest([0, 1])::BIGINT AS item) UNION ALL
 SELECT doc_id, page, item, nth, CASE WHEN on_page AND len(own_reasons) + len(shape) = 0 THEN taken || takes ELSE taken END, seq, op, CASE WHEN on_page THEN [] ELSE ['page_number_mismatch'] END || own_reasons || shape
 FROM (SELECT s.*, w.taken, flatten(list_transform(range(1, len(s.takes) + 1), lambda i: (CASE WHEN s.there[i] THEN [] ELSE ['target_ref_not_found'] END) || (CASE WHEN list_contains(w.taken, s.takes[i]) THEN ['target_already_modified'] ELSE [] END))) AS own_reasons FROM walk{x} w JOIN sm{x} s ON s.doc_id = w.doc_id AND s.page = w.page AND s.item = w.item AND s.nth = w.nth + 1)),
ruled{x} AS (SELECT doc_id, page, item, seq, op, reasons FROM walk{x} WHERE nth > 0)"""


def ruled(spark, sf_dir) -> DataFrame:
    items = lines(spark, sf_dir)
    return V.validated(commands_of(items), contexts_of(items))


@query(f"WITH RECURSIVE {PAGES_SQL}, {ruled_sql("")} SELECT doc_id, page, seq, op, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS valid FROM ruled")
def command_rules(spark, sf_dir):
    """V5: what speaks against commands of all sixteen operations, references looked up in their pages, those that earlier ones took included."""
    return ruled(spark, sf_dir).select("doc_id", "page", "seq", "op", F.array_join("reasons", ",").alias("reasons"), "valid")


_MEND = " OR ".join([*(f"contains(x, '{p}')" for p in fixed.MENDABLE_PARTS), "starts_with(x, 'invalid_')", "ends_with(x, '_not_found')", "starts_with(x, 'table_correction_')", "starts_with(x, 'task_op_not_allowed:')"])


@query(f"WITH RECURSIVE {PAGES_SQL}, {ruled_sql("")}, a AS (SELECT doc_id, seq, reasons || ['table_correction_requires_manual_review', 'invalid_thing', 'task_op_not_allowed:' || op] AS r FROM ruled), e AS (SELECT doc_id, seq, list_filter(r, lambda x: NOT contains(x, 'requires_manual_review') AND ({_MEND})) AS r FROM a) SELECT doc_id, seq, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ',') AS asked FROM e")
def reask_reasons(spark, sf_dir):
    """V8."""
    more = F.concat("reasons", F.array(F.lit("table_correction_requires_manual_review"), F.lit("invalid_thing"), F.concat(F.lit("task_op_not_allowed:"), "op")))
    return ruled(spark, sf_dir).select("doc_id", "seq", F.array_join(C.asked_again(more), ",").alias("asked"))


#: Which commands the provider answers with at each attempt: all, then one a page, then one on every other page.
_ANSWERS = ("seq >= 0", "seq % 6 < 2", "seq % 6 IN (2, 3) AND (doc_id + page) % 2 = 0")
_SIGNATURE = "op || '|' || coalesce(ref, '') || '|' || other_ref || '|' || text || '|' || coalesce(label, '')"


def reviewed(spark, sf_dir) -> review_run.Review:
    """Two items a page, each with every other command, answered from a record."""
    items = lines(spark, sf_dir)
    work = items.select("doc_id", F.col("page_no").alias("page"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("item")).distinct().withColumn("task", F.lit(None).cast("string"))

    def replayed(opened: DataFrame, attempt: int) -> DataFrame:
        asked = opened.groupBy("doc_id", F.col("page").alias("page_no")).agg(F.collect_set("item").alias("asked"))
        at = items.select("doc_id", "pos", "page_no").join(asked, ["doc_id", "page_no"]).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
        at = at.where(F.array_contains("asked", F.col("half").cast("long")))
        return at.selectExpr(*_command(Spark, "half"), "half % 2L AS item").where(_ANSWERS[attempt - 1])

    return review_run.run(work, replayed, contexts_of(items), len(_ANSWERS))


_ASK = f"list_filter(reasons, lambda x: NOT contains(x, 'requires_manual_review') AND ({_MEND}))"
_ROUNDS = ", ".join(ruled_sql(str(a), kept, "seq % 2") for a, kept in enumerate(_ANSWERS, 1))
_FAULTS = ", ".join(f"f{a} AS (SELECT doc_id, page, item, flatten(list({_ASK} ORDER BY seq)) AS asked FROM ruled{a} GROUP BY ALL)" for a in (1, 2, 3))
_RUN = f"""{PAGES_SQL}, {_ROUNDS}, {_FAULTS}, w AS (SELECT DISTINCT doc_id, page, seq % 2 AS item FROM cmd1),
q AS (SELECT w.*, list_filter(coalesce(a1.asked, []), lambda x, i: list_position(coalesce(a1.asked, []), x) = i) AS x1, list_filter(coalesce(a2.asked, []), lambda x, i: list_position(coalesce(a2.asked, []), x) = i) AS x2, list_filter(coalesce(a3.asked, []), lambda x, i: list_position(coalesce(a3.asked, []), x) = i) AS x3
 FROM w LEFT JOIN f1 a1 USING (doc_id, page, item) LEFT JOIN f2 a2 USING (doc_id, page, item) LEFT JOIN f3 a3 USING (doc_id, page, item)),
st AS (SELECT doc_id, page, item, CASE WHEN len(x1) = 0 THEN 1 WHEN len(x2) = 0 THEN 2 ELSE 3 END AS attempts, CASE WHEN len(x1) = 0 THEN 'passed' WHEN len(x2) = 0 OR len(x3) = 0 THEN 'reasked' ELSE 'failed' END AS status,
 CASE WHEN len(x1) = 0 THEN [] WHEN len(x2) = 0 THEN x1 WHEN len(x3) = 0 THEN x2 ELSE x3 END AS feedback FROM q)"""


@query(f"WITH RECURSIVE {_RUN} SELECT doc_id, page, item, attempts, status, array_to_string(feedback, ',') AS feedback FROM st")
def review_rounds(spark, sf_dir):
    """Work items through up to three rounds."""
    return reviewed(spark, sf_dir).items.select("doc_id", "page", "item", "attempts", "status", F.array_join("feedback", ",").alias("feedback"))


_PENALTY = "CASE " + " ".join(f"WHEN op = '{op}' THEN {p}::DOUBLE" for op, p in fixed.RISK_PENALTIES.items()) + " ELSE 0::DOUBLE END"
_RULED_ON = f"""d0 AS ({' UNION ALL '.join(f"SELECT c.*, r.item, r.reasons, c{a}.own FROM cmd{a} c JOIN ruled{a} r USING (doc_id, page, seq) JOIN j{a} c{a} USING (doc_id, page, seq) JOIN st s ON s.doc_id = r.doc_id AND s.page = r.page AND s.item = r.item AND s.attempts = {a} AND s.status <> 'failed'" for a in (1, 2, 3))}),
d1 AS (SELECT *, len(reasons) = 0 AS valid, (op = 'replaceText' AND coalesce(list_contains(own.suspect, 'hanja_ocr_candidate'), false)) OR (op = 'removeText' AND coalesce(list_contains(own.suspect, 'picture_internal_text'), false)) AS trusted, '#/texts/' || ((page - 1) * 3) AS t0, '#/texts/' || ((page - 1) * 3 + 1) AS t1, '#/texts/' || ((page - 1) * 3 + 2) AS t2 FROM d0),
d2 AS (SELECT *, CASE op WHEN 'addText' THEN text IN ('ww', 'www') WHEN 'updateBbox' THEN ref = t0 WHEN 'linkFootnote' THEN other_ref = t2 WHEN 'moveNode' THEN (ref = t0 AND other_ref = t1 AND label = 'after') OR (ref = t1 AND other_ref = t0 AND label = 'before') END AS evidenced, round(greatest(0, least(1, confidence - CASE WHEN trusted AND op = 'removeText' THEN 0 ELSE {_PENALTY} END)), 9) AS final FROM d1),
d3 AS (SELECT *, CASE WHEN NOT valid OR final < {fixed.PROPOSAL_FROM} THEN 'skipped' WHEN final >= CASE WHEN trusted THEN {fixed.TRUSTED_AUTO_FROM} ELSE {fixed.AUTO_FROM} END AND (op IN ('replaceText', 'updateTextRole', 'removeText', 'updatePictureCaption') OR coalesce(evidenced, false)) THEN 'auto_applied' ELSE 'proposal' END AS disposition, {_SIGNATURE} AS signature FROM d2),
d4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, signature ORDER BY final DESC, seq) AS dn FROM d3) WHERE dn = 1),
tch AS (SELECT doc_id, page, seq, unnest(CASE WHEN op IN ('addText', 'addPicture') THEN [] WHEN op = 'linkFootnote' THEN [ref, other_ref] ELSE [ref] END) AS r FROM d4 WHERE disposition <> 'skipped'),
edg AS (SELECT DISTINCT a.doc_id, a.page, a.seq AS x, b.seq AS y FROM tch a JOIN tch b ON a.doc_id = b.doc_id AND a.page = b.page AND a.r = b.r AND a.seq <> b.seq),
grow AS (SELECT doc_id, page, x, y FROM edg UNION SELECT g.doc_id, g.page, g.x, e.y FROM grow g JOIN edg e ON g.doc_id = e.doc_id AND g.page = e.page AND g.y = e.x),
grp AS (SELECT doc_id, page, x AS seq, min(least(x, y)) AS root FROM grow GROUP BY ALL),
rnk AS (SELECT g.*, d.final, row_number() OVER (PARTITION BY g.doc_id, g.page, root ORDER BY d.final DESC, g.seq) AS n FROM grp g JOIN d4 d USING (doc_id, page, seq)),
clr AS (SELECT doc_id, page, seq, n, round(max(final) FILTER (n = 1) OVER w - max(final) FILTER (n = 2) OVER w, 9) > 0.3 AS clear FROM rnk WINDOW w AS (PARTITION BY doc_id, page, root))"""


@query(f"""WITH RECURSIVE {_RUN}, {_RULED_ON} SELECT d.doc_id, d.page AS page_no, d.seq, d.op, d.final AS confidence, CASE WHEN n IS NOT NULL AND NOT clear AND disposition = 'auto_applied' THEN 'proposal' ELSE disposition END AS disposition
FROM d4 d LEFT JOIN clr USING (doc_id, page, seq) WHERE NOT coalesce(n > 1 AND clear, false)""")
def review_decisions(spark, sf_dir):
    """The decisions that a review ends with."""
    found = reviewed(spark, sf_dir).decisions.withColumn("signature", F.expr(_SIGNATURE))
    return review_run.ruled_on(found).select("doc_id", "page_no", "seq", "op", "confidence", "disposition")
