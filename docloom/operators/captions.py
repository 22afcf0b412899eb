"""Captions through a parser's answers, recovery, a validator's verdicts and a second parser.

Answers come by position in a document's list of given captions. Where their number is right they are aligned by position;
where it isn't, each caption takes the answer that quotes its whole text (of several the last), and captions without one are
lost. Verdicts come by position in the list that is left. The rejected ones are parsed again, one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: str = "idx", name: str = "place") -> DataFrame:
    """Places from 0 on within each document."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1).cast("long"))


def aligned(given: DataFrame, parsed: DataFrame) -> DataFrame:
    """doc_id, idx, text, num, full_text, recovered, place of the captions (doc_id, idx, text) with an answer (doc_id, place, num, full_text)."""
    g = numbered(given.where("text is not null"))
    asked, got = g.groupBy("doc_id").agg(F.count("*").alias("asked")), parsed.groupBy("doc_id").agg(F.count("*").alias("got"))
    right = asked.join(got, "doc_id").select("doc_id", (F.col("asked") == F.col("got")).alias("right"))
    both = g.join(right, "doc_id")
    by_place = both.where("right").join(numbered(parsed, "place", "at").select("doc_id", F.col("at").alias("place"), "num", "full_text"), ["doc_id", "place"])
    last = parsed.groupBy("doc_id", F.col("full_text").alias("text")).agg(F.max_by(F.struct("num", "full_text"), "place").alias("p"))
    by_text = both.where("not right").join(last, ["doc_id", "text"]).select("doc_id", "idx", "text", "p.num", "p.full_text", F.lit(True).alias("recovered"))
    all_ = by_place.select("doc_id", "idx", "text", "num", "full_text", F.lit(False).alias("recovered")).unionByName(by_text)
    return numbered(all_)


def processed(given: DataFrame, parsed: DataFrame, verdicts: DataFrame | None, reparsed: DataFrame | None) -> DataFrame:
    """C4: doc_id, idx, num, full_text, outcome (parsed, recovered, reparsed, doubtful).

    ``verdicts`` are doc_id, place, is_valid by place among the aligned captions, null for a batch size of 0: all are valid then;
    a missing verdict counts as valid. ``reparsed`` are doc_id, place, num, full_text by place among the rejected ones, null without
    a second model; a rejected caption that it doesn't answer stays as it is, doubtful.
    """
    a = aligned(given, parsed)
    v = a.withColumn("is_valid", F.lit(True)) if verdicts is None else a.join(verdicts, ["doc_id", "place"], "left").withColumn("is_valid", F.coalesce("is_valid", F.lit(True)))
    good = v.where("is_valid").select("doc_id", "idx", "num", "full_text", F.when(F.col("recovered"), "recovered").otherwise("parsed").alias("outcome"))
    bad = numbered(v.where("not is_valid").drop("place"))
    if reparsed is None:
        return good.unionByName(bad.select("doc_id", "idx", "num", "full_text", F.lit("doubtful").alias("outcome")))
    again = reparsed.select("doc_id", "place", F.struct("num", "full_text").alias("r"))
    new = bad.join(again, ["doc_id", "place"], "left")
    pick = lambda c: F.when(F.col("r").isNotNull(), F.col(f"r.{c}")).otherwise(F.col(c)).alias(c)
    return good.unionByName(new.select("doc_id", "idx", pick("num"), pick("full_text"), F.when(F.col("r").isNotNull(), "reparsed").otherwise("doubtful").alias("outcome")))
