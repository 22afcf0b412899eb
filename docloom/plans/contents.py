"""Contents of documents: where rules find them, what they read like, which source is taken.

Lines stand in groups of four, some of which hold the next group, in the body, below another line, or nowhere; some groups'
lines end in page numbers, every other document has marked lines; some pages hold a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.operators import contents as C, items as I
from docloom.plans.commands import Duck, Spark
from docloom.plans.context import _KINDS, MARKS, lines
from docloom.plans.documents import _re2
from docloom.sources.shared import written

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _columns(d) -> dict[str, str]:
    """Expressions over lines, or over (doc_id, g) of groups and (doc_id, page_no) of pages, for both engines."""
    g = d.half("pos", "4")
    marks = d.array(*("'" + m.replace("'", "''") + "'" for m in MARKS))
    return {
        "g": g, "grouped": f"((doc_id + {g}) % 5 <> 4)",
        "text": f"CASE WHEN (doc_id + {g}) % 7 < 3 THEN text || ' ..... ' || (pos % 90) WHEN doc_id % 2 = 0 THEN {d.pick(marks, f'(pos % {len(MARKS)})')} || text ELSE text END",
        "parent": f"CASE WHEN (doc_id + {g}) % 5 <> 4 THEN '#/groups/' || {g} WHEN pos % 3 = 0 THEN NULL WHEN pos % 3 = 1 THEN '#/body' ELSE '#/texts/' || (pos - 1) END",
        "name": "CASE g % 4 WHEN 2 THEN 'other' WHEN 1 THEN 'group' ELSE 'list' END", "table": "(doc_id + page_no) % 4 = 1", "index": "(doc_id + page_no) % 8 = 1", "rows": "(page_no % 4 + 1)",
        "like": "((doc_id + page_no) % 8 = 1 OR (page_no % 4 + 1 >= 3 AND page_no % 2 = 0))", "resource": "page_no % 3 = 0",
        "enumerated": "CASE pos % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END", "marker": "CASE WHEN pos % 5 = 0 THEN '*' ELSE '' END",
        "grid": f"CASE WHEN page_no % 5 = 0 THEN {d.array(d.none('string'), d.array(chr(39) + 'only' + chr(39)))} ELSE {d.array(d.array(chr(39) + 'Title | x' + chr(39), chr(39) + ' Page ' + chr(39)), d.array(chr(39) + 'T' + chr(39) + ' || page_no', chr(39) + chr(39) + ' || page_no'))} END",
    }


def tree(spark, sf_dir) -> dict[str, DataFrame]:
    """texts, groups (with their facts), tables, edges and pieces of the documents, written once as a document store holds them."""
    c, l = _columns(Spark), lines(spark, sf_dir)
    tx = l.selectExpr("doc_id", "pos AS ord", "self_ref AS ref", f"{c['parent']} AS parent_ref", "page_no", f"{c['text']} AS text", f"{c['enumerated']} AS enumerated", f"{c['marker']} AS marker")
    gr = l.selectExpr("doc_id", f"{c['g']} AS g", f"{c['grouped']} AS grouped").where("grouped").select("doc_id", "g").distinct().selectExpr("doc_id", "g AS ord", "'#/groups/' || g AS ref", f"{c['name']} AS name")
    tb = l.select("doc_id", "page_no").distinct().where(c["table"]).selectExpr("doc_id", "page_no AS ord", "'#/tables/' || page_no AS ref", "page_no", f"{c['index']} AS is_index", f"{c['rows']} AS rows", f"{c['like']} AS contents_like", f"{c['resource']} AS resource_index", f"{c['grid']} AS grid")
    tx, gr, tb = written(tx, "tree-texts"), written(gr, "tree-groups"), written(tb, "tree-tables")
    edge = lambda df, parent, child, pos: df.selectExpr("doc_id", f"{parent} AS parent_ref", f"{child} AS child_ref", f"CAST({pos} AS bigint) AS child_pos")
    inner = gr.where("ord % 4 <> 3").join(gr.select("doc_id", (F.col("ord") - 1).alias("ord")), ["doc_id", "ord"], "left_semi")
    ed = (
        edge(tx.where("parent_ref LIKE '#/groups/%'"), "parent_ref", "ref", "ord").unionByName(edge(tx.where("parent_ref = '#/body'"), "parent_ref", "ref", "ord * 10")).unionByName(edge(gr, "'#/body'", "ref", "ord * 40 + 5"))
        .unionByName(edge(tb, "'#/body'", "ref", "page_no * 30 - 24")).unionByName(edge(inner, "ref", "'#/groups/' || (ord + 1)", "1000000")).unionByName(edge(gr.where("ord % 5 = 0"), "ref", "'#/texts/999999'", "-1"))
    )
    ed = written(ed, "tree-edges")
    none = lambda kind: F.lit(None).cast(kind)
    grid = "array<array<string>>"
    pieces = (
        tx.select("doc_id", "ref", F.lit("text").alias("kind"), "page_no", "text", "enumerated", "marker", none(grid).alias("rows"))
        .unionByName(tb.select("doc_id", "ref", F.lit("table").alias("kind"), "page_no", none("string").alias("text"), none("boolean").alias("enumerated"), none("string").alias("marker"), F.col("grid").alias("rows")))
        .unionByName(gr.select("doc_id", "ref", F.when(F.col("name").isin(*C.LISTS), "list").otherwise("other").alias("kind"), none("long").alias("page_no"), none("string").alias("text"), none("boolean").alias("enumerated"), none("string").alias("marker"), none(grid).alias("rows")))
    )
    return {"texts": tx, "groups": C.group_facts(gr, ed, pieces), "tables": tb.drop("grid"), "edges": ed, "pieces": pieces}


_D = _columns(Duck)
_NUMBERED = f"regexp_matches(p.text, '{_re2(fixed.PAGE_NUMBER)}')"
FOUND_SQL = f"""{I.ITEMS_SQL}, tx AS (SELECT doc_id, pos AS ord, self_ref AS ref, {_D['parent']} AS parent_ref, page_no, {_D['text']} AS text, {_D['enumerated']} AS enumerated, {_D['marker']} AS marker FROM items),
gr AS (SELECT doc_id, g AS ord, '#/groups/' || g AS ref, {_D['name']} AS name FROM (SELECT DISTINCT doc_id, {_D['g']} AS g FROM items WHERE {_D['grouped']})),
tb AS (SELECT doc_id, page_no AS ord, '#/tables/' || page_no AS ref, page_no, {_D['index']} AS is_index, {_D['rows']} AS rows, {_D['like']} AS contents_like, {_D['resource']} AS resource_index, {_D['grid']} AS grid FROM (SELECT DISTINCT doc_id, page_no FROM items) WHERE {_D['table']}),
ed AS (SELECT doc_id, parent_ref, ref AS child_ref, ord AS child_pos FROM tx WHERE starts_with(parent_ref, '#/groups/') UNION ALL SELECT doc_id, parent_ref, ref, ord * 10 FROM tx WHERE parent_ref = '#/body' UNION ALL SELECT doc_id, '#/body', ref, ord * 40 + 5 FROM gr
 UNION ALL SELECT doc_id, '#/body', ref, page_no * 30 - 24 FROM tb UNION ALL SELECT a.doc_id, a.ref, b.ref, 1000000 FROM gr a JOIN gr b ON a.doc_id = b.doc_id AND b.ord = a.ord + 1 WHERE a.ord % 4 <> 3 UNION ALL SELECT doc_id, ref, '#/texts/999999', -1 FROM gr WHERE ord % 5 = 0),
pc AS (SELECT doc_id, ref, page_no, text FROM tx UNION ALL SELECT doc_id, ref, page_no, NULL FROM tb UNION ALL SELECT doc_id, ref, NULL, NULL FROM gr),
gf AS (SELECT g.*, n, hits, page_no, name IN ('list', 'group') AND (hits >= 3 OR 2 * hits > known) AS contents_like FROM gr g JOIN (SELECT e.doc_id, e.parent_ref AS ref, count(*) AS n, count(p.ref) AS known, count(*) FILTER ({_NUMBERED}) AS hits, arg_min(p.page_no, e.child_pos) FILTER (p.page_no IS NOT NULL) AS page_no
 FROM ed e LEFT JOIN pc p ON p.doc_id = e.doc_id AND p.ref = e.child_ref GROUP BY ALL) USING (doc_id, ref)),
kw AS (SELECT * FROM tx WHERE ({_KINDS['toc_keywords']}) AND page_no <= 10),
climb AS (SELECT doc_id, ref, parent_ref AS at FROM tx UNION ALL SELECT c.doc_id, c.ref, t.parent_ref FROM climb c JOIN tx t ON t.doc_id = c.doc_id AND t.ref = c.at),
cont AS (SELECT c.doc_id, c.ref, c.at FROM climb c JOIN (SELECT doc_id, ref FROM gr UNION ALL SELECT doc_id, ref FROM tb) h ON h.doc_id = c.doc_id AND h.ref = c.at),
bd AS (SELECT doc_id, child_ref, row_number() OVER (PARTITION BY doc_id ORDER BY child_pos) AS n FROM ed WHERE parent_ref = '#/body'),
lk AS (SELECT doc_id, ref, page_no FROM gf WHERE contents_like UNION ALL SELECT doc_id, ref, page_no FROM tb WHERE contents_like),
sib AS (SELECT k.doc_id, k.ref, arg_min(o.child_ref, o.n) AS s FROM kw k JOIN bd b ON b.doc_id = k.doc_id AND b.child_ref = k.ref JOIN bd o ON o.doc_id = b.doc_id AND o.n BETWEEN b.n + 1 AND b.n + 3 JOIN lk l ON l.doc_id = o.doc_id AND l.ref = o.child_ref AND l.page_no = k.page_no GROUP BY ALL),
led AS (SELECT k.doc_id, k.ord, k.page_no, k.parent_ref IS NOT NULL AS grows, CASE WHEN k.parent_ref IS NULL THEN k.ref ELSE coalesce(c.at, s.s) END AS area FROM kw k LEFT JOIN cont c USING (doc_id, ref) LEFT JOIN sib s USING (doc_id, ref)),
k1 AS (SELECT doc_id, 'keyword' AS stage, arg_min(area, ord) AS ref, arg_min(page_no, ord) AS page_no, arg_min(grows, ord) AS grows FROM led WHERE area IS NOT NULL GROUP BY doc_id),
cand AS (SELECT doc_id, ref, page_no, 0 AS k, ord, (11 - page_no) * 10 + n * 2 + hits * 5 AS score FROM gf WHERE contents_like AND page_no <= 10 UNION ALL SELECT doc_id, ref, page_no, 1, ord, (11 - page_no) * 10 + rows * 2 + CASE WHEN is_index THEN 50 ELSE 0 END - CASE WHEN resource_index THEN 100 ELSE 0 END FROM tb WHERE contents_like AND page_no <= 10),
s1 AS (SELECT * FROM k1 UNION ALL SELECT doc_id, 'structure', ref, page_no, true FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k, ord) AS n FROM cand) WHERE n = 1 AND doc_id NOT IN (SELECT doc_id FROM k1)),
g0 AS (SELECT t.doc_id, t.page_no, 0 AS rank, t.ord, t.parent_ref AS ref FROM tx t JOIN gr g ON g.doc_id = t.doc_id AND g.ref = t.parent_ref WHERE {_KINDS['continuations']}),
going AS (SELECT * FROM g0 UNION ALL SELECT doc_id, page_no, 1, ord, ref FROM gf WHERE contents_like AND (doc_id, page_no, ref) NOT IN (SELECT doc_id, page_no, ref FROM g0) UNION ALL SELECT doc_id, page_no, 2, ord, ref FROM tb WHERE contents_like AND NOT resource_index),
gp AS (SELECT DISTINCT doc_id, page_no FROM going),
back AS (SELECT doc_id, page_no AS p, 0 AS turn FROM s1 WHERE grows UNION ALL SELECT b.doc_id, b.p - 1, turn + 1 FROM back b JOIN gp ON gp.doc_id = b.doc_id AND gp.page_no = b.p - 1),
fwd AS (SELECT doc_id, page_no AS p, 0 AS turn FROM s1 WHERE grows UNION ALL SELECT b.doc_id, b.p + 1, turn + 1 FROM fwd b JOIN gp ON gp.doc_id = b.doc_id AND gp.page_no = b.p + 1 WHERE b.p < 10),
met AS (SELECT doc_id, p, turn FROM back WHERE turn > 0 UNION ALL SELECT doc_id, p, turn + 1000 FROM fwd WHERE turn > 0),
nw AS (SELECT g.*, m.turn, min(m.turn) OVER (PARTITION BY g.doc_id, g.ref) AS first FROM going g JOIN met m ON m.doc_id = g.doc_id AND m.p = g.page_no JOIN s1 s ON s.doc_id = g.doc_id WHERE g.ref <> s.ref),
rf AS (SELECT doc_id, page_no, rank, ord, ref FROM nw WHERE turn = first UNION ALL SELECT doc_id, page_no, -1, -1, ref FROM s1),
found AS (SELECT s.doc_id, s.stage, coalesce(b.lo, s.page_no) AS start_page, coalesce(f.hi, s.page_no) AS end_page, r.refs FROM s1 s LEFT JOIN (SELECT doc_id, min(p) AS lo FROM back GROUP BY 1) b USING (doc_id) LEFT JOIN (SELECT doc_id, max(p) AS hi FROM fwd GROUP BY 1) f USING (doc_id) JOIN (SELECT doc_id, list(ref ORDER BY page_no, rank, ord) AS refs FROM rf GROUP BY 1) r USING (doc_id))"""


def found(t: dict[str, DataFrame]) -> DataFrame:
    return C.find(t["texts"], t["groups"], t["tables"], t["edges"])


@query(f"WITH RECURSIVE {FOUND_SQL} SELECT doc_id, stage, start_page, end_page, array_to_string(refs, ',') AS refs FROM found")
def contents_found(spark, sf_dir):
    """Keyword, container, siblings, structure, growth over pages."""
    return found(tree(spark, sf_dir)).select("doc_id", "stage", "start_page", "end_page", F.array_join("refs", ",").alias("refs"))


_TRIM = "regexp_replace({}, '^[\\s\\x{{A0}}\\x{{FEFF}}]+|[\\s\\x{{A0}}\\x{{FEFF}}]+$', '', 'g')".replace("{{", "{").replace("}}", "}")
MARKDOWN_SQL = f"""{FOUND_SQL}, sr AS (SELECT doc_id, unnest(refs) AS ref, generate_subscripts(refs, 1) AS pos FROM found),
ln AS (SELECT doc_id, ref, CASE WHEN marker <> '' THEN marker || ' ' WHEN enumerated THEN '1. ' ELSE '- ' END || {_TRIM.replace('{}', 'text')} AS line FROM tx WHERE {_TRIM.replace('{}', 'text')} <> ''),
wk AS (SELECT s.doc_id, s.pos, s.ref, 0 AS depth, []::BIGINT[] AS path FROM sr s JOIN gr g USING (doc_id, ref) WHERE g.name <> 'other' UNION ALL SELECT w.doc_id, w.pos, e.child_ref, depth + 1, list_append(path, e.child_pos) FROM wk w JOIN ed e ON e.doc_id = w.doc_id AND e.parent_ref = w.ref JOIN gr g ON g.doc_id = e.doc_id AND g.ref = e.child_ref AND g.name <> 'other'),
bl AS (SELECT doc_id, pos, string_agg(repeat('  ', depth) || line, chr(10) ORDER BY p) AS block FROM (SELECT w.doc_id, w.pos, depth, l.line, list_append(path, e.child_pos) AS p FROM wk w JOIN ed e ON e.doc_id = w.doc_id AND e.parent_ref = w.ref JOIN ln l ON l.doc_id = e.doc_id AND l.ref = e.child_ref) GROUP BY ALL
 UNION ALL SELECT doc_id, pos, line FROM sr JOIN ln USING (doc_id, ref) UNION ALL SELECT doc_id, pos, CASE WHEN tb.page_no % 5 = 0 THEN '| only |' ELSE '| Title \\| x | Page |' || chr(10) || '| --- | --- |' || chr(10) || '| T' || tb.page_no || ' | ' || tb.page_no || ' |' END FROM sr JOIN tb USING (doc_id, ref)),
md AS (SELECT f.doc_id, coalesce(string_agg(b.block, chr(10) || chr(10) ORDER BY b.pos), '') AS markdown FROM found f LEFT JOIN bl b USING (doc_id) GROUP BY 1)"""


def written_out(t: dict[str, DataFrame], areas: DataFrame) -> DataFrame:
    return C.markdown(areas.select("doc_id", F.posexplode("refs").alias("pos", "ref")), t["pieces"], t["edges"])


@query(f"WITH RECURSIVE {MARKDOWN_SQL} SELECT doc_id, length(markdown) AS chars, md5(markdown) AS markdown FROM md")
def contents_markdown(spark, sf_dir):
    """Lists of several levels, tables and texts of the contents found."""
    t = tree(spark, sf_dir)
    return written_out(t, found(t)).select("doc_id", F.length("markdown").cast("long").alias("chars"), F.md5("markdown").alias("markdown"))


_VERDICT = "CASE WHEN doc_id % 5 <> 1 THEN TRUE ELSE FALSE END AS is_valid, CASE WHEN doc_id % 7 = 3 THEN 0.69E0 ELSE 0.7E0 END AS confidence, CASE doc_id % 3 WHEN 0 THEN 'pure_toc' WHEN 1 THEN 'mixed' ELSE 'invalid' END AS content_type, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Main ..... ' || (doc_id % 30) END AS extracted"
_VISION = "CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Seen ..... ' || (doc_id % 50) END AS markdown"
_MADE = ("CASE WHEN doc_id % 2 = 0 THEN 0 ELSE doc_id % 11 END", "doc_id % 4")


@query(f"""WITH RECURSIVE {MARKDOWN_SQL}, d AS (SELECT doc_id, max(page_no) AS pages FROM items GROUP BY 1), v AS (SELECT doc_id, {_VERDICT} FROM d),
r AS (SELECT doc_id, CASE WHEN is_valid AND confidence >= 0.7 AND trim(md.markdown) <> '' THEN CASE WHEN content_type = 'pure_toc' THEN md.markdown WHEN content_type = 'mixed' AND extracted <> '' THEN extracted END END AS rules FROM md JOIN v USING (doc_id)),
x AS (SELECT d.doc_id, d.pages, r.rules, nullif(s.markdown, '') AS seen, {_MADE[0].replace('doc_id', 'd.doc_id')} AS a, {_MADE[1].replace('doc_id', 'd.doc_id')} AS b FROM d LEFT JOIN r USING (doc_id) JOIN (SELECT doc_id, {_VISION} FROM d) s USING (doc_id)),
y AS (SELECT *, CASE WHEN rules IS NULL THEN CASE WHEN seen IS NULL THEN NULL ELSE 'vision' END WHEN a = 0 AND seen IS NOT NULL AND b > 0 THEN 'vision' ELSE 'rules' END AS source FROM x),
z AS (SELECT *, CASE source WHEN 'rules' THEN rules WHEN 'vision' THEN seen END AS m, CASE source WHEN 'rules' THEN a WHEN 'vision' THEN b ELSE 0 END AS n FROM y),
o AS (SELECT *, coalesce(list_max(list_transform(regexp_extract_all(m, '\\.{{2,}}[ \\t]*(\\d+)', 1) || regexp_extract_all(m, '\\|[ \\t]*(\\d+)[ \\t]*\\|[ \\t]*(?:\\n|\\z)', 1), lambda q: q::INT)), 0) AS last FROM z)
SELECT doc_id, source, md5(m) AS markdown, n::BIGINT AS entries, CASE WHEN m IS NOT NULL AND last <= pages THEN pages END AS total_pages, CASE WHEN source IS NULL THEN 'not_located' WHEN n = 0 THEN 'no_entries' END AS reason FROM o""")
def contents_sources(spark, sf_dir):
    """Rules, verdict, images, second try with images."""
    t = tree(spark, sf_dir)
    docs = t["texts"].groupBy("doc_id").agg(F.max("page_no").alias("pages"))
    ruled = C.judged(written_out(t, found(t)), docs.selectExpr("doc_id", *_VERDICT.split(", CASE ")[:1], *("CASE " + x for x in _VERDICT.split(", CASE ")[1:])))
    made = docs.selectExpr("doc_id", "'rules' AS source", f"{_MADE[0]} AS entries").unionByName(docs.selectExpr("doc_id", "'vision' AS source", f"{_MADE[1]} AS entries"))
    out = C.cascade(docs, ruled, docs.selectExpr("doc_id", _VISION), made)
    return out.select("doc_id", "source", F.md5("markdown").alias("markdown"), "entries", "total_pages", "reason")
