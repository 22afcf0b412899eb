"""Chapters: ranges from contents entries, items assigned by page, ordered contents, ids, tree and navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.shared import written

LAST_PAGE = 9_007_199_254_740_991


def padded_id(prefix: str, n: Column) -> Column:
    """The number with three digits at least."""
    return F.concat(F.lit(prefix), F.format_string("%03d", n))


def sequential_ids(df: DataFrame, prefix: str, order: list[str], name: str = "id") -> DataFrame:
    """Dense ids a document, from 1."""
    return df.withColumn(name, padded_id(prefix, F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))))


def actual_pages(df: DataFrame, page_ranges: DataFrame, pdf_page: str = "page_no", name: str = "page") -> DataFrame:
    """The printed page of a scanned one; pages without a range are their own, and a mapped 0 stays 0."""
    ranges = page_ranges.select(F.col("doc_id").alias("__d"), F.col("pdf_page").alias("__p"), "start_page")
    joined = df.join(ranges, (F.col("doc_id") == F.col("__d")) & (F.col(pdf_page) == F.col("__p")), "left")
    return joined.withColumn(name, F.coalesce("start_page", F.col(pdf_page))).drop("__d", "__p", "start_page")


def chapter_ranges(toc: DataFrame, front_matter: bool = False) -> DataFrame:
    """Entries by start page, then place; each ends before the next starts, the last never.

    Of entries that start on one page all but the last get an empty range. With ``front_matter`` a chapter -1 reaches
    from page 1 to the page before the first.
    """
    order = Window.partitionBy("doc_id").orderBy("start_page", "k")
    ranges = toc.select("doc_id", "k", "start_page", F.coalesce(F.lead("start_page").over(order) - 1, F.lit(LAST_PAGE)).alias("end_page"))
    if not front_matter:
        return ranges
    first = toc.groupBy("doc_id").agg((F.min("start_page") - 1).alias("end_page")).where("end_page >= 1")
    return ranges.unionByName(first.select("doc_id", F.lit(-1).cast("long").alias("k"), F.lit(1).cast("long").alias("start_page"), "end_page"))


def assign(items: DataFrame, ranges: DataFrame, page: str = "page_no") -> DataFrame:
    """Each item with the chapter whose range holds its page; items in none are dropped.

    Ranges of one document don't overlap, so they are laid out page by page, no further than the document's last page,
    and joined on (document, page): an equi-join where a range condition would compare all pairs.
    """
    last = items.groupBy("doc_id").agg(F.max(page).alias("__last"))
    pages = ranges.where("end_page >= start_page").join(last, "doc_id").where(F.col("start_page") <= F.col("__last"))
    pages = pages.select("doc_id", "k", F.explode(F.sequence(F.col("start_page"), F.least("end_page", "__last"))).alias(page))
    return items.join(pages, ["doc_id", page])


def contents(assigned: DataFrame, kinds: list[str], kind: str = "label", order: str = "pos", value: str = "self_ref") -> DataFrame:
    """The ordered references of each kind in each chapter, joined by commas."""
    pick = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(kind) == k, F.struct(order, value)))), lambda x: x[value]), ",")
    return assigned.groupBy("doc_id", "k").agg(*(pick(k).alias(k) for k in kinds))


def smallest_containing(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """The chapter of the least span that holds a page, the first of equal ones; spans may overlap, and reach beyond the last page."""
    last = pages.groupBy("doc_id").agg(F.max("page_no").alias("__last"))
    inside = ranges.join(last, "doc_id").where((F.col("start_page") <= F.col("__last")) & (F.col("start_page") <= F.col("end_page")))
    laid = inside.select("doc_id", "k", (F.col("end_page") - F.col("start_page")).alias("span"), F.explode(F.sequence("start_page", F.least("end_page", "__last"))).alias("page_no"))
    best = laid.groupBy("doc_id", "page_no").agg(F.min_by("k", F.struct("span", "k")).alias("k"))
    return pages.join(best, ["doc_id", "page_no"], "left")


def subtree(nodes: DataFrame) -> DataFrame:
    """Level and preorder of a forest of (doc_id, id, parent, ordinal), however deep, with the ordinals from the root as ``path``.

    Every turn joins a node's path to that of the node it hangs on, so turns grow with the logarithm of the depth. What
    hangs on an unknown node or on itself is left out.
    """
    now = nodes.select("doc_id", "id", F.col("parent").alias("up"), F.array(F.col("ordinal").cast("long")).alias("path"))
    sizes = nodes.groupBy("doc_id").agg(F.count("*").alias("__most"))
    while not (hanging := now.where("up is not null")).isEmpty():
        on = now.select(F.col("doc_id").alias("__d"), F.col("id").alias("__i"), F.col("up").alias("__up"), F.col("path").alias("__path"))
        step = hanging.join(on, (F.col("doc_id") == F.col("__d")) & (F.col("up") == F.col("__i"))).select("doc_id", "id", F.col("__up").alias("up"), F.concat("__path", "path").alias("path"))
        no_ring = step.join(sizes, "doc_id").where(F.size("path") <= F.col("__most")).drop("__most")
        now = written(now.where("up is null").unionByName(no_ring), "subtree")
    order = Window.partitionBy("doc_id").orderBy("path")
    return now.select("doc_id", "id", F.size("path").alias("level"), "path", F.row_number().over(order).alias("preorder"))


def inverse_pages(page_ranges: DataFrame) -> DataFrame:
    """The scanned pages of each printed page, ascending."""
    laid = page_ranges.where("start_page > 0 and end_page >= start_page").select("doc_id", "pdf_page", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    return laid.groupBy("doc_id", "page").agg(F.min("pdf_page").alias("first_pdf_page"), F.count("*").alias("n_pdf_pages"))
