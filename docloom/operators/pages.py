"""Printed page numbers of scanned pages: groups of like size, patterns of samples, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from docloom.functions.text import half_up

def _pages() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("page")


def size_key(width: Column, height: Column) -> Column:
    return F.concat(half_up(width / 5).cast("long").cast("string"), F.lit("x"), half_up(height / 5).cast("long").cast("string"))


def size_islands(pages: DataFrame) -> DataFrame:
    """Runs of pages of one size key (doc_id, page, size_key)."""
    new = F.coalesce((F.lag("size_key").over(_pages()) != F.col("size_key")).cast("int"), F.lit(1))
    marked = pages.withColumn("new", new).withColumn("island", F.sum("new").over(_pages().rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "island", "size_key").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n_pages"))


def pattern(samples: DataFrame) -> DataFrame:
    """Of samples (doc_id, page, number): same step, double step, constant offset within 1, or unknown; two valid at least."""
    step = lambda c: F.col(c) - F.lag(c).over(_pages())
    valid = samples.where("number > 0").withColumn("dp", step("page")).withColumn("dn", step("number")).withColumn("offset", F.col("number") - F.col("page"))
    sums = valid.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.bool_and(F.col("dn") == F.col("dp")).alias("same"), F.bool_and(F.col("dn") == 2 * F.col("dp")).alias("double"),
        F.max("offset").alias("hi"), F.min("offset").alias("lo"), half_up(F.avg("offset")).cast("long").alias("mean"),
    )
    near = (F.col("hi") - F.col("mean") <= 1) & (F.col("mean") - F.col("lo") <= 1)
    name = F.when(F.col("n") < 2, "unknown").when(F.col("same"), "simple_increment").when(F.col("double"), "double_sided").when(near, "offset").otherwise("unknown")
    return sums.select("doc_id", F.col("n").alias("n_valid"), name.alias("pattern"), F.col("mean").alias("mean_offset"))


def extrapolated(pages: DataFrame, patterns: DataFrame, samples: DataFrame) -> DataFrame:
    """Printed ranges of all pages from a document's pattern and its first valid sample."""
    first = samples.where("number > 0").groupBy("doc_id").agg(F.min_by(F.struct(F.col("page").alias("p"), F.col("number").alias("n")), "page").alias("f"))
    d = F.col("page") - F.col("f.p")
    start = F.when(F.col("pattern") == "double_sided", F.col("f.n") + 2 * d).when(F.col("pattern") == "simple_increment", F.col("f.n") + d).when(F.col("pattern") == "offset", F.col("page") + F.col("mean_offset")).otherwise(F.lit(0))
    end = F.when(F.col("pattern") == "double_sided", start + 1).otherwise(start)
    return pages.join(patterns, "doc_id", "left").join(first, "doc_id", "left").select("doc_id", "page", F.coalesce(start, F.lit(0)).alias("start_page"), F.coalesce(end, F.lit(0)).alias("end_page"))


def drop_outliers(ranges: DataFrame) -> DataFrame:
    """Before the first run of three regular pages, numbers more than 10 above what the run implies become 0."""
    a, b = F.lead("number", 1).over(_pages()) - F.col("number"), F.lead("number", 2).over(_pages()) - F.lead("number", 1).over(_pages())
    runs = ranges.withColumn("run", (F.col("number") > 0) & (a == b) & a.isin(1, 2)).withColumn("step", a)
    first = runs.where("run").groupBy("doc_id").agg(F.min_by(F.struct("page", "number", "step"), "page").alias("r"))
    expected = F.col("r.number") - (F.col("r.page") - F.col("page")) * F.col("r.step")
    odd = (F.col("page") < F.col("r.page")) & (F.col("number") > expected + 10)
    return ranges.join(first, "doc_id", "left").select("doc_id", "page", F.when(odd, F.lit(0)).otherwise(F.col("number")).cast("long").alias("number"))


def repair_drops(ranges: DataFrame) -> DataFrame:
    """Where a number falls by more than 1, all pages before are counted back from it; the last such fall wins.

    No earlier number is read after it was rewritten, so this needs no loop: falls depend on the given numbers alone.
    """
    prev = F.lag("number").over(_pages())
    falls = ranges.withColumn("fall", F.when((F.col("number") > 0) & (prev > 0) & (prev - F.col("number") > 1), F.struct("page", "number")))
    later = F.last("fall", ignorenulls=True).over(_pages().rowsBetween(1, Window.unboundedFollowing))
    fixed = falls.withColumn("later", later)
    return fixed.select("doc_id", "page", F.when(F.col("later").isNotNull(), F.col("later.number") - (F.col("later.page") - F.col("page"))).otherwise(F.col("number")).alias("number"))


def no_negatives(ranges: DataFrame) -> DataFrame:
    """W8."""
    return ranges.withColumn("number", F.greatest("number", F.lit(0).cast("long")))


def backfill(ranges: DataFrame) -> DataFrame:
    """Zeros from the document's mean offset, if two pages or more are good and the result is 1 or more."""
    doc = Window.partitionBy("doc_id")
    good = F.when(F.col("number") > 0, F.col("number") - F.col("page"))
    filled = ranges.withColumn("n", F.count(good).over(doc)).withColumn("mean", half_up(F.avg(good).over(doc)).cast("long"))
    new = F.col("page") + F.col("mean")
    return filled.select("doc_id", "page", F.when((F.col("number") == 0) & (F.col("n") >= 2) & (new >= 1), new).otherwise(F.col("number")).alias("number"))


def post_processed(ranges: DataFrame) -> DataFrame:
    """W10."""
    return backfill(no_negatives(repair_drops(drop_outliers(ranges))))


def is_double_sided(ranges: DataFrame) -> DataFrame:
    """Over half of the mapped pages hold two printed ones."""
    two = F.count_if((F.col("end_page") - F.col("start_page") == 1) & (F.col("start_page") > 0))
    return ranges.groupBy("doc_id").agg((two > F.count_if(F.col("start_page") > 0) / 2).alias("double_sided"))


def sample_pages(pages: DataFrame, most: int = 15, trim: float = 0.1) -> DataFrame:
    """Up to ``most`` evenly spaced pages of the document without its ends."""
    n = pages.groupBy("doc_id").agg(F.max("page").alias("n"))
    cut = F.greatest(F.ceil(F.col("n") * trim), F.lit(1))
    room = n.withColumn("lo", cut + 1).withColumn("hi", F.col("n") - cut)
    size = F.col("hi") - F.col("lo") + 1
    k = F.least(size, F.lit(most))
    places = F.when(size <= 0, F.array(F.ceil(F.col("n") / 2))).otherwise(F.transform(F.sequence(F.lit(0), k - 1), lambda i: (F.col("lo") + F.floor(i * size / k)).cast("long")))
    return room.select("doc_id", F.explode(places).alias("page")).withColumn("page", F.col("page").cast("long"))
