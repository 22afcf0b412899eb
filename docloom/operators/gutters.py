"""Gutters of pictures, stretches of bins with hardly any ink between sides that have some."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import geometry as G

#: Ink of a gutter at most, of a side at least, a gutter's width at least, and how near the edges it may not come.
EMPTY, INKED, NARROW, EDGE = 0.06, 0.18, 0.025, 0.08


def runs(densities: Column, empty: float = EMPTY) -> Column:
    """Array of struct<start, end> (end exclusive) of the stretches of bins at or below ``empty``."""
    n = F.size(densities)
    low = lambda i: F.coalesce(F.get(densities, i) <= empty, F.lit(False))
    bins = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts, ends = F.filter(bins, lambda i: low(i) & ~low(i - 1)), F.filter(bins, lambda i: low(i) & ~low(i + 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end")))


def average(densities: Column, start: Column, end: Column) -> Column:
    """The mean of a stretch, 0 for an empty one; summed from its last bin on, as the SQL's avg mostly does over large tables: scores can be halves of the last digit."""
    total = F.aggregate(F.reverse(F.slice(densities, start + 1, F.greatest(end - start, F.lit(0)))), F.lit(0.0), lambda s, x: s + x)
    return F.when(end > start, total / (end - start)).otherwise(0.0)


def best_gutter(densities: Column) -> Column:
    """struct<score, start, end> of the best gutter, the first of equal ones, null without any."""
    n = F.size(densities)
    wide = F.greatest(F.lit(1), F.ceil(n * NARROW))

    def judged(r: Column) -> Column:
        before, after, inside = average(densities, F.lit(0), r["start"]), average(densities, r["end"], n), average(densities, r["start"], r["end"])
        width = F.least(F.lit(1.0), (r["end"] - r["start"]) / F.greatest(F.lit(1.0), n * 0.08))
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), G.gutter_score(1 - inside, F.least(before, after), width)))
        ok = (r["end"] - r["start"] >= wide) & (r["start"] > n * EDGE) & (r["end"] < n * (1 - EDGE)) & (before >= INKED) & (after >= INKED)
        return F.struct(F.when(ok, score).alias("score"), (-r["start"]).alias("back"), r["end"].alias("end"))

    found = F.filter(F.transform(runs(densities), judged), lambda x: x["score"].isNotNull())
    best = F.array_max(found)
    return F.when(F.size(found) > 0, F.struct(best["score"].alias("score"), (-best["back"]).alias("start"), best["end"].alias("end")))
