"""Where a document's contents are, what they read like, and which of several sources gives them.

Stages are tried as the reference tries them, the first success of a document wins: each stage works on the documents that the
ones before left. Node tables: texts (doc_id, ord, ref, parent_ref, page_no, text), groups (doc_id, ord, ref, name), tables
(doc_id, ord, ref, page_no, is_index, rows, contents_like, resource_index), edges (doc_id, parent_ref, child_ref, child_pos).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import context, toc
from docloom.sources.shared import written

BODY = "#/body"
#: Siblings that are looked at after a keyword.
NEAR = 3
LISTS = ("list", "group")
#: V3: verdicts below this confidence don't count.
SURE = 0.7


def group_facts(groups: DataFrame, edges: DataFrame, pieces: DataFrame) -> DataFrame:
    """Groups with how many children they name, the first page of one, T14's count of page numbers and verdict.

    ``pieces`` are all nodes: doc_id, ref, page_no (null for groups) and text (null for what has none).
    """
    p = pieces.select("doc_id", F.col("ref").alias("child_ref"), "page_no", T.ends_in_page_number(F.col("text")).alias("hit"), F.lit(True).alias("there"))
    children = edges.withColumnRenamed("parent_ref", "ref").join(p, ["doc_id", "child_ref"], "left")
    facts = children.groupBy("doc_id", "ref").agg(
        F.count("*").alias("children"), F.count("there").alias("known"), F.count_if("hit").alias("hits"),
        F.min_by("page_no", F.when(F.col("page_no").isNotNull(), F.col("child_pos"))).alias("page_no"),
    )
    g = groups.join(facts, ["doc_id", "ref"], "left").fillna(0, ["children", "known", "hits"])
    like = F.col("name").isin(*LISTS) & ((F.col("hits") >= 3) | ((F.col("known") > 0) & (F.col("hits") > 0.5 * F.col("known"))))
    return g.withColumn("contents_like", F.coalesce(like, F.lit(False)))


def marked(texts: DataFrame) -> DataFrame:
    """Texts with a keyword or a mark of continuation, and which: the only pass over the texts themselves."""
    both = texts.select("doc_id", "ord", "ref", "parent_ref", "page_no", T.is_toc_keyword(F.col("text")).alias("keyword"), T.is_continuation(F.col("text")).alias("goes_on"))
    return written(both.where("keyword or goes_on"), "contents-marks")


def containers(words: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, ref, container: what the parents of these few texts lead to above all texts, a turn a level; rings lead nowhere."""
    up = texts.where("parent_ref is not null").select("doc_id", F.col("ref").alias("at"), F.col("parent_ref").alias("next"))
    now, out = words.select("doc_id", "ref", F.col("parent_ref").alias("at"), F.array("ref").alias("seen")), []
    while True:
        out.append(now.where(~F.col("at").startswith("#/texts/")).select("doc_id", "ref", F.col("at").alias("container")))
        climbing = now.where(F.col("at").startswith("#/texts/") & ~F.array_contains("seen", F.col("at")))
        if climbing.isEmpty():
            break
        now = written(climbing.join(up, ["doc_id", "at"]).select("doc_id", "ref", F.col("next").alias("at"), F.concat("seen", F.array("at")).alias("seen")), "contents-climb")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def by_keyword(marks: DataFrame, texts: DataFrame, groups: DataFrame, tables: DataFrame, edges: DataFrame, most: int = context.SEARCHED_PAGES) -> DataFrame:
    """C2, first stage: the first text with a keyword on an early page that leads to an area.

    A text without parent is the area itself; else the first group or table above it is; else, in the body, one of
    the next siblings that stands on its page and looks like contents. ``marks`` are ``marked`` texts, ``groups`` ``group_facts``.
    """
    words = marks.where(F.col("keyword") & (F.col("page_no") <= most))
    above = containers(words, texts)
    held = groups.select("doc_id", F.col("ref").alias("container")).unionByName(tables.select("doc_id", F.col("ref").alias("container")))
    above = above.join(held, ["doc_id", "container"], "left_semi")
    likely = groups.where("contents_like").select("doc_id", F.col("ref").alias("child_ref"), F.col("page_no").alias("at")).unionByName(tables.where("contents_like").select("doc_id", F.col("ref").alias("child_ref"), F.col("page_no").alias("at")))
    order = Window.partitionBy("doc_id").orderBy("child_pos")
    row = edges.where(F.col("parent_ref") == BODY).join(likely, ["doc_id", "child_ref"], "left")
    ahead = [F.lead(F.struct("child_ref", "at"), i).over(order) for i in range(1, NEAR + 1)]
    beside = row.select("doc_id", F.col("child_ref").alias("ref"), F.array(*ahead).alias("ahead"))
    found = words.join(above, ["doc_id", "ref"], "left").join(beside, ["doc_id", "ref"], "left")
    sibling = F.get(F.filter("ahead", lambda x: x["at"] == F.col("page_no")), F.lit(0))["child_ref"]
    area = F.when(F.col("parent_ref").isNull(), F.col("ref")).otherwise(F.coalesce("container", sibling))
    led = found.withColumn("area", area).where("area is not null")
    first = led.groupBy("doc_id").agg(F.min_by(F.struct("area", "page_no", F.col("parent_ref").isNotNull().alias("grows")), "ord").alias("f"))
    return first.select("doc_id", F.lit("keyword").alias("stage"), F.col("f.area").alias("ref"), "f.page_no", "f.grows")


def by_structure(groups: DataFrame, tables: DataFrame, most: int = context.SEARCHED_PAGES) -> DataFrame:
    """C2, second stage: the best of the groups and tables on early pages that look like contents; lists of figures score 100 less."""
    g = groups.where(F.col("contents_like") & (F.col("page_no") <= most)).select("doc_id", F.col("ord").cast("long").alias("ord"), "ref", "page_no", toc.text_score(F.col("page_no"), F.col("children"), F.col("hits"), most).cast("long").alias("score"))
    score = (most - F.col("page_no") + 1) * 10 + toc.table_score(F.col("rows"), F.col("is_index"), F.col("resource_index"))
    t = tables.where(F.col("contents_like") & (F.col("page_no") <= most)).select("doc_id", (F.col("ord") + (1 << 40)).cast("long").alias("ord"), "ref", "page_no", score.cast("long").alias("score"))
    return context.best_candidate(g.unionByName(t)).select("doc_id", F.lit("structure").alias("stage"), "ref", "page_no", F.lit(True).alias("grows"))


def continuations(marks: DataFrame, groups: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, page_no, rank, ord, ref of what carries contents on: groups of marked texts, groups and tables that look like contents."""
    g = groups.select("doc_id", F.col("ref").alias("parent_ref"))
    led = marks.where(F.col("goes_on") & F.col("page_no").isNotNull()).join(g, ["doc_id", "parent_ref"], "left_semi").select("doc_id", "page_no", F.lit(0).alias("rank"), F.col("ord").cast("long").alias("ord"), F.col("parent_ref").alias("ref"))
    listed = groups.where("contents_like and page_no is not null").join(led.select("doc_id", "page_no", "ref").distinct(), ["doc_id", "page_no", "ref"], "left_anti")
    rest = tables.where("contents_like and not resource_index and page_no is not null")
    return led.unionByName(listed.select("doc_id", "page_no", F.lit(1).alias("rank"), F.col("ord").cast("long").alias("ord"), "ref")).unionByName(rest.select("doc_id", "page_no", F.lit(2).alias("rank"), F.col("ord").cast("long").alias("ord"), "ref"))


def grown(start: DataFrame, going_on: DataFrame, most: int = context.SEARCHED_PAGES) -> DataFrame:
    """Areas with their pages and references in order: what neighbouring pages add, each reference on the page that first met it.

    Pages before the start are met from the last to the first, then those after it.
    """
    pages = context.contents_area(start.where("grows"), going_on, most)
    more = going_on.join(start.where("grows").select("doc_id", F.col("ref").alias("own"), F.col("page_no").alias("begin")), "doc_id").join(pages, "doc_id")
    more = more.where(F.col("page_no").between(F.col("start_page"), F.col("end_page")) & (F.col("page_no") != F.col("begin")) & (F.col("ref") != F.col("own")))
    turn = F.when(F.col("page_no") < F.col("begin"), F.col("begin") - F.col("page_no")).otherwise(F.col("page_no") + (1 << 30))
    new = more.withColumn("turn", turn).withColumn("met", F.min("turn").over(Window.partitionBy("doc_id", "ref"))).where("turn = met").select("doc_id", "page_no", "rank", "ord", "ref")
    own = start.select("doc_id", "page_no", F.lit(-1).alias("rank"), F.lit(-1).cast("long").alias("ord"), "ref")
    refs = own.unionByName(new).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "rank", "ord", "ref"))), lambda x: x["ref"]).alias("refs"))
    j = start.select("doc_id", "stage", "page_no").join(pages, "doc_id", "left").join(refs, "doc_id")
    return j.select("doc_id", "stage", F.coalesce("start_page", "page_no").alias("start_page"), F.coalesce("end_page", "page_no").alias("end_page"), "refs")


def find(texts: DataFrame, groups: DataFrame, tables: DataFrame, edges: DataFrame, most: int = context.SEARCHED_PAGES) -> DataFrame:
    """doc_id, stage, start_page, end_page, refs of the documents whose contents rules find. ``groups`` are ``group_facts``."""
    marks, groups = marked(texts), written(groups, "contents-groups")
    first = written(by_keyword(marks, texts, groups, tables, edges, most), "contents-keyword")
    second = by_structure(groups, tables, most).join(first, "doc_id", "left_anti")
    return grown(first.unionByName(second), continuations(marks, groups, tables), most)


def markdown(starts: DataFrame, pieces: DataFrame, edges: DataFrame) -> DataFrame:
    """Each start's (doc_id, pos, ref) text: lists indented by their depth, tables with a rule, single texts.

    ``pieces``: doc_id, ref, kind (list, text, table or other), text, enumerated, marker, rows (array of arrays of texts). A
    list's lines are those of all lists below it, depth first, so each turn takes the lists one deeper, lists alone; lines are joined
    once, with the path to their list, and one sort a start puts them in order. A list within itself isn't entered again; tables within lists say nothing.
    """
    marker = F.when(F.coalesce("marker", F.lit("")) != "", F.concat("marker", F.lit(" "))).when(F.coalesce("enumerated", F.lit(False)), "1. ").otherwise("- ")
    said = T.trimmed(F.coalesce("text", F.lit("")))
    named = pieces.withColumn("line", F.when((F.col("kind") == "text") & (said != ""), F.concat(marker, said)))
    at = starts.select("doc_id", "pos", "ref").join(named.select("doc_id", "ref", "kind", "line", "rows"), ["doc_id", "ref"])
    at = written(at.select("doc_id", "pos", "ref", "kind", F.when(F.col("kind") == "table", table_markdown(F.col("rows"))).otherwise(F.col("line")).alias("block")), "markdown-starts")
    whole = at.where("kind in ('text', 'table')").select("doc_id", "pos", "block")
    inner = pieces.where("kind = 'list'").select("doc_id", F.col("ref").alias("child_ref"))
    inner = written(edges.withColumnRenamed("parent_ref", "ref").join(inner, ["doc_id", "child_ref"], "left_semi"), "markdown-lists")
    now = at.where("kind = 'list'").select("doc_id", "pos", "ref", F.array().cast("array<long>").alias("path"), F.array("ref").alias("above"))
    lists = [now]
    while True:
        below = now.join(inner, ["doc_id", "ref"]).where(~F.array_contains("above", F.col("child_ref")))
        now = written(below.select("doc_id", "pos", F.col("child_ref").alias("ref"), F.concat("path", F.array(F.col("child_pos").cast("long"))).alias("path"), F.concat("above", F.array("child_ref")).alias("above")), "markdown-level")
        if now.isEmpty():
            break
        lists.append(now)
    met = lists[0]
    for more in lists[1:]:
        met = met.unionByName(more)
    lines = named.where("line is not null").select("doc_id", F.col("ref").alias("child_ref"), "line")
    listed = met.select("doc_id", "pos", "ref", "path").join(edges.withColumnRenamed("parent_ref", "ref"), ["doc_id", "ref"]).join(lines, ["doc_id", "child_ref"])
    listed = listed.select("doc_id", "pos", F.concat("path", F.array(F.col("child_pos").cast("long"))).alias("path"), F.concat(F.repeat(F.lit("  "), F.size("path")), "line").alias("line"))
    lists = listed.groupBy("doc_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "\n").alias("block"))
    blocks = whole.unionByName(lists).where(F.coalesce("block", F.lit("")) != "")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "\n\n")
    return starts.select("doc_id").distinct().join(blocks.groupBy("doc_id").agg(text.alias("markdown")), "doc_id", "left").fillna("", ["markdown"])


def table_markdown(rows: Column) -> Column:
    """A grid's rows as pipes, a rule below the first one; rows without cells are left out, the rule with the first."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    cell = lambda c: T.trimmed(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    each = F.transform(rows, lambda r, i: F.when(F.size(r) == 0, F.array().cast("array<string>")).when(i == 0, F.array(line(F.transform(r, cell)), line(F.transform(r, lambda _: F.lit("---"))))).otherwise(F.array(line(F.transform(r, cell)))))
    return F.array_join(F.flatten(each), "\n")


def judged(found: DataFrame, verdicts: DataFrame, sure: float = SURE) -> DataFrame:
    """V3: the markdown that a verdict (doc_id, is_valid, confidence, content_type, extracted) leaves: all of pure contents, what was extracted from mixed ones, else null."""
    v = found.join(verdicts, "doc_id", "left")
    ok = F.col("is_valid") & (F.col("confidence") >= sure) & (T.trimmed(F.col("markdown")) != "")
    kept = F.when(F.col("content_type") == "pure_toc", F.col("markdown")).when((F.col("content_type") == "mixed") & (F.col("extracted") != ""), F.col("extracted"))
    return v.select("doc_id", F.when(ok, kept).alias("markdown"))


def cascade(documents: DataFrame, ruled: DataFrame, vision: DataFrame, extracted: DataFrame) -> DataFrame:
    """doc_id, source, markdown, entries, total_pages as the extractor may know it, and why nothing was found.

    ``documents`` are doc_id, pages; ``ruled`` the judged markdown; ``vision`` (doc_id, markdown) what images give;
    ``extracted`` (doc_id, source, entries) how many entries the extractor makes of either. Rules come first; vision stands in
    where they leave nothing, and once more where the extractor makes nothing of their text. Page numbers beyond the document's
    last page mean that its pages aren't known to the extractor.
    """
    r = ruled.select("doc_id", F.col("markdown").alias("ruled"))
    seen = vision.where(F.coalesce("markdown", F.lit("")) != "").select("doc_id", F.col("markdown").alias("seen"))
    made = extracted.groupBy("doc_id").pivot("source", ["rules", "vision"]).agg(F.max("entries"))
    j = documents.join(r, "doc_id", "left").join(seen, "doc_id", "left").join(made, "doc_id", "left").fillna(0, ["rules", "vision"])
    retried = F.col("ruled").isNotNull() & (F.col("rules") == 0) & F.col("seen").isNotNull() & (F.col("vision") > 0)
    source = F.when(retried, "vision").when(F.col("ruled").isNotNull(), "rules").when(F.col("seen").isNotNull(), "vision")
    j = j.withColumn("source", source).withColumn("markdown", F.when(F.col("source") == "rules", F.col("ruled")).when(F.col("source") == "vision", F.col("seen")))
    entries = F.when(F.col("source") == "rules", F.col("rules")).when(F.col("source") == "vision", F.col("vision")).otherwise(0)
    total = F.when(F.col("markdown").isNotNull() & (toc.max_page(F.col("markdown")) <= F.col("pages")), F.col("pages"))
    why = F.when(F.col("source").isNull(), "not_located").when(F.col("entries") == 0, "no_entries")
    return j.withColumn("entries", entries).select("doc_id", "source", "markdown", F.col("entries").cast("long").alias("entries"), total.alias("total_pages"), why.alias("reason"))
