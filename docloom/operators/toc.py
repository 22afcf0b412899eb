"""Contents lists: scores, validation rules, levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Page numbers at the ends of dotted lines.
_LEADER = r"\.{2,}[ \t]*(\d+)"


def max_page(markdown: Column) -> Column:
    """The largest page number after dot leaders or in a row's last cell, 0 if there is none."""
    dotted = F.regexp_extract_all(markdown, F.lit(_LEADER), F.lit(1))
    cells = F.regexp_extract_all(markdown, F.lit(r"\|[ \t]*(\d+)[ \t]*\|[ \t]*(?:\n|\z)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(F.concat(dotted, cells), lambda x: x.cast("int"))), F.lit(0))


def text_score(page: Column, children: Column, page_numbers: Column, max_pages: int = 10) -> Column:
    """M13."""
    return (max_pages - page + 1) * 10 + children * 2 + page_numbers * 5


def table_score(rows: Column, is_index: Column, is_resource: Column) -> Column:
    """M13."""
    return rows * 2 + F.when(is_index, 50).otherwise(0) - F.when(is_resource, 100).otherwise(0)


def leveled(entries: DataFrame) -> DataFrame:
    """V2: the level is the depth of the path, the title is trimmed."""
    return entries.withColumn("level", F.size(F.split("path", "/"))).withColumn("title", F.trim("title"))


def issues(entries: DataFrame, total_pages: DataFrame) -> DataFrame:
    """V1: the rules V001-V007 over (doc_id, k, parent, title, page), k in preorder; one row a broken rule.

    Siblings are compared with the one before, the first with its parent.
    """
    up = entries.select(F.col("doc_id").alias("__d"), F.col("k").alias("__k"), F.col("page").alias("parent_page"))
    sibling = Window.partitionBy("doc_id", "parent").orderBy("k")
    e = entries.join(total_pages, "doc_id").join(up, (F.col("doc_id") == F.col("__d")) & (F.col("parent") == F.col("__k")), "left")
    e = e.withColumn("prev", F.coalesce(F.lag("page").over(sibling), "parent_page"))
    e = e.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "title", "page").orderBy("k")))
    e = e.withColumn("first", F.row_number().over(Window.partitionBy("doc_id").orderBy("k")))
    title = F.trim("title")
    long = F.length(title) + F.regexp_count(title, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    rules = {
        "V001": F.col("page") < F.col("prev"),
        "V002": (F.col("page") < 1) | (F.col("page") > F.col("total_pages")),
        "V003": title == "",
        "V004": long > 200,
        "V005": F.col("page") < F.col("parent_page"),
        "V006": F.col("copy") > 1,
        "V007": (F.col("first") == 1) & (F.col("page") > F.greatest(F.lit(50), F.floor(F.col("total_pages") * 0.3))),
    }
    broken = F.filter(F.array(*(F.when(rule, F.lit(code)) for code, rule in rules.items())), lambda c: c.isNotNull())
    return e.select("doc_id", "k", F.explode(broken).alias("code"))
