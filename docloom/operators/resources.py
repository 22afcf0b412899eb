"""Images, tables and footnotes: grid normalisation, summaries, table checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def span(start: Column, end: Column, given: Column) -> Column:
    """The difference of offsets if there is one, else the given span, else 1; never less than 1."""
    return F.greatest(F.lit(1), F.coalesce(F.nullif(end - start, F.lit(0)), given, F.lit(1)))


def anchored_grid(cells: DataFrame) -> DataFrame:
    """Of a raw grid (key columns, row, col, start_row, start_col, ...) each cell once, in its anchor row and column.

    Shadows of spanning cells go; of several cells at an anchor the first counts.
    """
    at_row, at_col = F.coalesce("start_row", "row"), F.coalesce("start_col", "col")
    own = cells.where(at_row == F.col("row")).withColumn("anchor_col", at_col)
    first = own.withColumn("__n", F.row_number().over(Window.partitionBy("table_id", "row", "anchor_col").orderBy("col"))).where("__n = 1").drop("__n")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("table_id", "row").orderBy("anchor_col")))


def cells_to_rows(cells: DataFrame) -> DataFrame:
    """The ordered texts of every row from 0 to the last, empty rows included."""
    rows = cells.groupBy("table_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]).alias("texts"))
    every = cells.groupBy("table_id").agg(F.max("row").alias("last")).select("table_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("row"))
    return every.join(rows, ["table_id", "row"], "left").select("table_id", "row", F.coalesce("texts", F.array().cast("array<string>")).alias("texts"))


def grid_size(cells: DataFrame) -> DataFrame:
    """Rows, and the widest row's sum of column spans."""
    wide = cells.groupBy("table_id", "row").agg(F.sum(F.greatest(F.lit(1), F.coalesce("col_span", F.lit(1)))).alias("w"))
    return wide.groupBy("table_id").agg((F.max("row") + 1).alias("num_rows"), F.max("w").alias("num_cols"))


def empty_ratio(cells: DataFrame) -> DataFrame:
    """A7."""
    return cells.groupBy("table_id").agg(F.coalesce(F.try_divide(F.count_if(F.trim(F.coalesce("text", F.lit(""))) == ""), F.count("*")), F.lit(0.0)).alias("empty_ratio"))


def looks_like_contents(cells: DataFrame) -> DataFrame:
    """Three rows and two columns at least, and over half of the last column's cells below the header are digits."""
    size = cells.groupBy("table_id").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    ends = cells.join(size, "table_id").where((F.col("col") == F.col("cols") - 1) & (F.col("row") > 0))
    digits = ends.groupBy("table_id").agg(F.count("*").alias("n"), F.count_if(F.trim("text").rlike(r"^\d+\z")).alias("d"))
    return size.join(digits, "table_id", "left").select("table_id", ((F.col("rows") >= 3) & (F.col("cols") >= 2) & (F.coalesce("d", F.lit(0)) > F.coalesce("n", F.lit(0)) / 2)).alias("contents_like"))


def shadows(cells: DataFrame) -> DataFrame:
    """The positions that spans cover besides their anchors."""
    r, c = F.sequence(F.col("row"), F.col("row") + F.greatest("row_span", F.lit(1)) - 1), F.sequence(F.col("col"), F.col("col") + F.greatest("col_span", F.lit(1)) - 1)
    wide = cells.where("row_span > 1 or col_span > 1").select("table_id", "row", "col", F.explode(r).alias("r"), c.alias("cs"))
    return wide.select("table_id", "row", "col", "r", F.explode("cs").alias("c")).where("r <> row or c <> col").select("table_id", F.col("r").alias("row"), F.col("c").alias("col"))


def blanked_grid(grid: Column) -> Column:
    """A grid (array of arrays of struct<text, start_row, start_col>) with cells away from their anchor emptied."""
    def cell(x: Column, i: Column, j: Column) -> Column:
        master = (x["start_row"] == i) & (x["start_col"] == j)
        return F.when(F.coalesce(master, F.lit(False)), x["text"]).otherwise("")

    return F.transform(grid, lambda row, i: F.transform(row, lambda x, j: cell(x, i, j)))


def summary(caption: Column, rows: Column, cols: Column, header: Column) -> Column:
    """T17."""
    return F.concat(F.coalesce(caption, F.lit("untitled")), F.lit(" ("), rows.cast("string"), F.lit(" x "), cols.cast("string"), F.lit("): "), F.array_join(header, ", "))


def violations(before: DataFrame, after: DataFrame, page_text: DataFrame) -> DataFrame:
    """Why a corrected table (table_id, row, col, text) can't stand: nothing changed, emptied, or foreign text."""
    both = before.alias("b").join(after.alias("a"), ["table_id", "row", "col"], "full").select("table_id", "row", "col", F.col("b.text").alias("old"), F.col("a.text").alias("new"))
    sums = both.groupBy("table_id").agg(
        F.count_if(~F.coalesce("old", F.lit("")).eqNullSafe(F.coalesce("new", F.lit("")))).alias("changed"),
        F.try_divide(F.count_if(F.trim(F.coalesce("new", F.lit(""))) == ""), F.count("*")).alias("empty_new"), F.try_divide(F.count_if(F.trim(F.coalesce("old", F.lit(""))) == ""), F.count("*")).alias("empty_old"),
    )
    noop = sums.where("changed = 0").select("table_id", F.lit("no_change").alias("violation"))
    emptied = sums.where("empty_new - empty_old > 0.35").select("table_id", F.lit("emptied"))
    foreign = both.where("new is not null and trim(new) <> ''").join(page_text, "table_id").where(~F.contains(F.col("page_text"), F.trim("new")) & ~F.coalesce("old", F.lit("")).eqNullSafe(F.col("new"))).select("table_id", F.lit("foreign_text")).distinct()
    return noop.unionAll(emptied).unionAll(foreign)


def pipe_table(rows: Column) -> Column:
    """A markdown table with a rule below its first row; rows are arrays of texts."""
    from docloom.functions.text import markdown_cell

    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, markdown_cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(rows[0], lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(rows[0]), rule), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")).otherwise("")
