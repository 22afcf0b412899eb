"""Token usage: roll-ups, reports, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import half_up

KRW_A_DOLLAR = 1450.0


def rollup(usage: DataFrame) -> DataFrame:
    """A1: sums by model, phase, component and overall, in one pass; ``level`` says which."""
    sums = [F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("total"), F.count("*").alias("calls")]
    sets = usage.groupingSets([["component", "phase", "role", "model"], ["component", "phase"], ["component"], []], "component", "phase", "role", "model")
    level = F.when(F.grouping("component") == 1, "all").when(F.grouping("phase") == 1, "component").when(F.grouping("model") == 1, "phase").otherwise("model").alias("level")
    return sets.agg(level, *sums)


def positional_zip(usage: DataFrame) -> DataFrame:
    """The n-th primary beside the n-th fallback model of each phase, by first use."""
    first = usage.groupBy("component", "phase", "role", "model").agg(F.min("seq").alias("seq"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("total"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("component", "phase", "role").orderBy("seq")))
    side = lambda r: ranked.where(F.col("role") == r).select("component", "phase", "n", F.col("model").alias(r), F.col("total").alias(f"{r}_total"))
    return side("primary").join(side("fallback"), ["component", "phase", "n"], "full")


def costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Dollars by component and phase, an unknown model free; six decimals."""
    priced = usage.join(F.broadcast(prices), "model", "left")  # a price list: a row a model
    cost = F.col("tokens_in") / 1e6 * F.coalesce("price_in", F.lit(0.0)) + F.col("tokens_out") / 1e6 * F.coalesce("price_out", F.lit(0.0))
    phases = priced.groupBy("component", "phase").agg(F.sum(cost).alias("c"))
    return phases.select("component", "phase", half_up(F.col("c"), 6).alias("usd"), half_up(F.col("c") * KRW_A_DOLLAR).cast("long").alias("krw"))


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """A3: the first report's rows before the second's, and the totals of both."""
    both = first.withColumn("source", F.lit(0)).unionByName(second.withColumn("source", F.lit(1)))
    return both.withColumn("total_all", F.sum(F.col("tokens_in") + F.col("tokens_out")).over(Window.partitionBy()))


def with_metadata(usage: DataFrame) -> DataFrame:
    """A2: a phase's call numbers in order, on its first row only."""
    phase = Window.partitionBy("component", "phase")
    rows = usage.groupBy("component", "phase", "role", "model").agg(F.min("seq").alias("first_seq"), F.sum("tokens_in").alias("tokens_in"))
    seqs = usage.groupBy("component", "phase").agg(F.count("*").alias("n_calls"))
    n = F.row_number().over(phase.orderBy("first_seq"))
    return rows.join(seqs, ["component", "phase"]).withColumn("metadata_calls", F.when(n == 1, F.col("n_calls"))).drop("n_calls")
