"""Quality rules: robust multivariate outliers by language and source, in DataFrame functions only.

Each whole text gives counts; the counts give a vector of transformed statistics. Per pool of rows a minimum-
covariance-determinant estimate is reached by concentration steps from two starts, the rows nearest the medians and
those of one half by lot: again and again mean and covariance of the ``CORE`` nearest rows are taken and all rows
measured by Mahalanobis distance, through a Cholesky factor written out as column expressions, until no determinant
falls further or ``STEPS`` are done; of the two the estimate with the least determinant counts. Rows beyond the chi-square quantile
are rejected.

A (lang, source) group of ``LEAST_ROWS`` rows and more, ten for each statistic, is judged by its own estimate; rows of
smaller groups by that of all rows of their language, and if those are fewer, too, by that of all rows. No row goes unjudged.

The estimates are one row a pool and start, computed with partial aggregation, so that a hot group is summed where its rows
are; they are broadcast where they are at most ``MOST_POOLS`` rows, and joined by shuffle beyond that. Text is read
once: the vectors are written to the shared folder and only they are read again.

Defined results: a null text has no words and fails the base rules; null lang or source are groups of their own;
repeated rows are each judged; ids may be null. Columns other than doc_id, text, lang and source are ignored; a table
without lang or source has them null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import WORD_GAP, materialize

SYMBOLS = r"[#*$%&|<>]"
CORE = 0.75
STEPS, STARTS = 10, 2
LEAST_ROWS = 50
#: Estimates that are broadcast, at most (some 300 bytes each).
MOST_POOLS = 20_000
#: Estimates have converged when no logarithm of a determinant changes by more.
CONVERGED = 1e-3
#: Chi-square with five degrees of freedom: the 0.75 quantile, the share of that with seven below it, and the 0.99999 quantile.
CHI2_CORE, CHI2_CORE_NEXT, CHI2_CUT = 6.6257, 0.5310, 30.856
#: The least spread that a statistic is taken to have: some are constant over clean text.
FLOORS = {"word_len": 0.05, "length": 0.5, "symbols": 0.05, "dup_lines": 0.15, "repeats": 0.13}
VECTOR = tuple(FLOORS)
P = len(VECTOR)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, group columns and the counts of each whole text."""
    pick = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), pick("lang").alias("lang"), pick("source").alias("source"))
    split = base.select(
        "doc_id", "lang", "source", F.array_remove(F.split("text", WORD_GAP), "").alias("words"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    n = F.size("words")
    hashes = F.slice(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))), 1, F.greatest(n - 2, F.lit(0)))
    sized = split.select(
        "doc_id", "lang", "source", n.cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").cast("long").alias("n_lines"), hashes.alias("h"),
    )
    # only texts in which some window recurs are sorted
    again = F.size(F.array_distinct("h")) < F.size("h")
    pairs = F.when(again, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    placed = sized.withColumn("s", pairs).drop("h")
    twice = F.filter("s", lambda x, j: x["h"].eqNullSafe(F.get("s", j - 1)["h"]) | x["h"].eqNullSafe(F.get("s", j + 1)["h"]))
    at = placed.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("s")
    # windows are three long: each covers three words, less what it shares with the one before
    covered = F.aggregate(F.transform("at", lambda x, j: F.least(F.lit(3), x - F.coalesce(F.get("at", j - 1), F.lit(-3)))), F.lit(0), lambda a, x: a + x)
    return at.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def with_vector(stats: DataFrame) -> DataFrame:
    """The counts with the base verdict and the transformed statistics: logarithms of sizes, arc sines of rates."""
    rate = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))))
    return stats.select(
        "*", ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.log(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)) + 1e-9).alias("word_len"), F.log1p("n_words").alias("length"),
        rate("n_symbols", "word_chars").alias("symbols"), rate("n_dup_lines", "n_lines").alias("dup_lines"), rate("n_repeat_words", "n_words").alias("repeats"),
    )


def _pool(level: int) -> Column:
    lang, source = (F.col("lang") if level else F.lit(None).cast("string")), (F.col("source") if level == 2 else F.lit(None).cast("string"))
    return F.to_json(F.struct(F.lit(level).alias("level"), lang.alias("lang"), source.alias("source")))


def _joined(rows: DataFrame, small: DataFrame, on: Column | str, how: str = "inner") -> DataFrame:
    """``rows`` with a table of a row a pool or group, broadcast if it is small enough."""
    return rows.join(F.broadcast(small) if small.count() <= MOST_POOLS else small, on, how)


def _pooled(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` with the pool each is judged in, and all pools whose estimate it takes part in."""
    own = materialize(rows.groupBy("lang", "source").agg(F.count("*").alias("n_own")), "mcd-groups")
    by_lang = own.groupBy(F.col("lang").alias("l")).agg(F.sum("n_own").alias("n_lang"))
    level = F.when(F.col("n_own") >= least, 2).when(F.col("n_lang") >= least, 1).otherwise(0)
    groups = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l"))).withColumn("level", level)
    groups = groups.withColumn("pool", F.when(F.col("level") == 2, _pool(2)).when(F.col("level") == 1, _pool(1)).otherwise(_pool(0)))
    asked = groups.select("pool").distinct()
    each = groups.select("lang", "source", F.explode(F.array(*(_pool(n) for n in range(3)))).alias("p")).join(asked.withColumnRenamed("pool", "p"), "p")
    pools = each.groupBy("lang", "source").agg(F.collect_set("p").alias("pools"))  # three at most
    keyed = lambda t, n: t.select(F.col("lang").alias(f"l{n}"), F.col("source").alias(f"s{n}"), *t.columns[2:])
    same = lambda n: F.col("lang").eqNullSafe(F.col(f"l{n}")) & F.col("source").eqNullSafe(F.col(f"s{n}"))
    known = keyed(groups.select("lang", "source", "pool"), 1).join(keyed(pools, 2), F.col("l1").eqNullSafe(F.col("l2")) & F.col("s1").eqNullSafe(F.col("s2"))).drop("l2", "s2")
    return _joined(rows, materialize(known, "mcd-pools"), same(1), "left").drop("l1", "s1")


def _with_distance(rows: DataFrame, params: DataFrame) -> DataFrame:
    """A column a coordinate, so that no expression is repeated inside the next."""
    out = _joined(rows, params, "pool")
    for i, v in enumerate(VECTOR):
        y = F.col(v) - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0"))
    return out.withColumn("d2", d2)


def _factored(moments: DataFrame) -> DataFrame:
    """Cholesky factors of the covariances, variances at least the floors', and the logarithms of their determinants."""
    out = moments
    for i in range(P):
        floor = FLOORS[VECTOR[i]] ** 2
        for j in range(i + 1):
            x = F.greatest(F.col(f"c{i}{j}"), F.lit(floor)) if i == j else F.col(f"c{i}{j}")
            for k in range(j):
                x = x - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(x, F.lit(floor * 1e-3))) if i == j else x / F.col(f"l{j}{j}"))
    volume = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, P)), F.log("l00"))
    return out.withColumn("volume", 2 * volume).drop(*(f"c{i}{j}" for i in range(P) for j in range(i + 1)))


def _moments(rows: DataFrame, scale: float) -> DataFrame:
    cov = [(scale * F.covar_pop(VECTOR[i], VECTOR[j])).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)]
    return rows.groupBy("pool", "start").agg(*(F.avg(v).alias(f"m{i}") for i, v in enumerate(VECTOR)), *cov)


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Of rows (pool, doc_id, the statistics) one row a pool: centre m*, and factor l* of its robust covariance."""
    quartiles = rows.groupBy("pool").agg(*(F.percentile_approx(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10000)).alias(f"q{i}") for i, v in enumerate(VECTOR)))
    medians = quartiles.select(
        "pool", F.lit(0).alias("start"), *(F.get(f"q{i}", F.lit(1)).alias(f"m{i}") for i in range(P)),
        *((F.pow((F.get(f"q{i}", F.lit(2)) - F.get(f"q{i}", F.lit(0))) / 1.349, 2.0) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)),
    )
    lot = rows.where(F.pmod(F.xxhash64("doc_id", *VECTOR), F.lit(2)) == 0).withColumn("start", F.lit(1))
    params = materialize(_factored(medians.unionByName(_moments(lot, 1.0))), "mcd-start")
    for _ in range(steps):
        near = _with_distance(rows, params.drop("volume")).drop(*(f"{a}{i}" for i in range(P) for a in "my"))
        reach = materialize(near.groupBy("pool", "start").agg(F.percentile_approx("d2", F.lit(CORE), F.lit(10000)).alias("reach")), "mcd-reach")
        core = _joined(near, reach, ["pool", "start"]).where(F.col("d2") <= F.col("reach"))
        now = materialize(_factored(_moments(core, CORE / CHI2_CORE_NEXT)), "mcd-step")
        fell = now.select("pool", "start", "volume").join(params.select("pool", "start", F.col("volume").alias("was")), ["pool", "start"]).agg(F.max(F.abs(F.col("was") - F.col("volume")))).first()[0]
        params = now
        if fell is None or fell < CONVERGED:
            break
    best = params.groupBy("pool").agg(F.min(F.struct("volume", "start")).alias("best"))
    return params.join(best, "pool").where(F.col("start") == F.col("best.start")).drop("best", "start", "volume")


def judge(docs: DataFrame, least: int = LEAST_ROWS, cut: float = CHI2_CUT) -> DataFrame:
    """doc_id, counts, base_failed, kept and the distance of every document row."""
    rows = materialize(with_vector(counts(docs)), "mcd-rows")
    tested = materialize(_pooled(rows.where(~F.col("base_failed")), least), "mcd-tested")
    params = materialize(estimates(tested.select("doc_id", *VECTOR, F.explode("pools").alias("pool"))), "mcd-params")
    near = _with_distance(tested.drop("pools"), params)
    fields = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = near.select(*fields, (F.col("d2") <= cut).alias("kept"), F.round("d2", 6).alias("distance"))
    failed = rows.where("base_failed").select(*fields, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return passed.unionByName(failed)
