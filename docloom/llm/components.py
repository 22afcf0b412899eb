"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a minimum per vertex and a join back, so a vertex with many neighbours is summed before it is shuffled
and its join can be split; what a step leaves is written to the shared folder, and deleted after the next step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch


def _is_flat(edges: DataFrame) -> bool:
    """Whether every vertex has one edge, and none that points elsewhere is pointed at: stars around roots."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    sums = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return sums.agg(F.coalesce(F.max((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))), F.lit(False))).first()[0] is False


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex ties its larger neighbours to the least of itself and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("w"), F.least("u", "least").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex ties itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionAll(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(vertex, root) of every vertex of ``edges`` (u, v: long) that isn't its component's least; the least is the root.

    Loops, repeated edges and either direction are allowed; a vertex that no row or only loops name has no row. The
    result is a table of ``scratch``.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    last = None
    while True:
        after = scratch.write(_small_star(_large_star(now)).distinct().toDF("vertex", "root"), "cc")
        now = after.toDF("u", "v")
        if last is not None:
            scratch.drop(last)
        if _is_flat(now):
            return after
        last = after
