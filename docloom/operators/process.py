"""Whole documents from items and contents entries to chapters with their contents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import chapters


def process(items: DataFrame, contents_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A row a document: pages, contents entries, those without a title, chapters that hold something, and their texts and tables.

    ``contents_of`` gives the entries (doc_id, k, title, start_page) of items (doc_id, pos, page_no, label, self_ref).
    Documents without entries stay, with no chapters.
    """
    entries = contents_of(items)
    held = chapters.assign(items, chapters.chapter_ranges(entries)).groupBy("doc_id").agg(
        F.countDistinct("k").alias("chapters"), F.count_if(F.col("label") == "text").alias("texts"), F.count_if(F.col("label") == "list_item").alias("tables"),
    )
    listed = entries.groupBy("doc_id").agg(F.count("*").alias("entries"), F.count_if(F.trim("title") == "").alias("untitled"))
    base = items.groupBy("doc_id").agg(F.max("page_no").alias("pages"))
    every = base.join(listed, "doc_id", "left").join(held, "doc_id", "left")
    return every.select("doc_id", "pages", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("entries", "untitled", "chapters", "texts", "tables")))
