"""Hard-negative mining by distributed radix selection.

Anchors, a stated set of rows, are taken in blocks of ``BLOCK``, whose vectors are what a task holds. Each pass reads all
rows, multiplies them with the block and counts scores by digit: for every window of an anchor (all scores for its positives;
a range of scores for the negatives of one positive) a histogram of ``1 << DIGIT`` buckets. Summed over all tasks it
shows the bucket of the kth score, which the next pass takes apart by the next digit, then, among equal scores, by digits of
the id, until at most ``LEFT`` rows are at or above it. A last pass gathers those alone, equal rows counted before they
are moved, and they are ranked. So no row is sorted, moved or kept but the few that qualify, and rows of one label or many
equal rows are never brought together; the driver sees a few numbers a window of the block.

Scores are integers: exact in doubles where they stay under 2**53, else computed as such and held within +-2**62. Rows
without id, label or vector, with a null or non-finite component (also after scaling), take no part; vectors of
another length than the anchor's have no score with it; equal anchor rows are one anchor; rows with the anchor's id
are not among its positives; repeated rows count each. Without anchors, positives or negatives there are no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, new_dir

POSITIVES, NEGATIVES = 5, 10
#: Negatives' scores in hundredths of the positive's.
LOWEST, HIGHEST = 30, 90
BLOCK, DIGIT, LEFT = 2048, 8, 64
#: Rows that are multiplied with a block at once.
ROWS = 1024
EXACT, MOST = float(1 << 53), 1 << 62
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def prepared(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, vector of the rows that take part: ids divisible by 7 get the next label, components are scaled and rounded down."""
    x = F.col("embedding")
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()
    scaled = F.transform(x, lambda v: v.cast("double") * float(scale))
    finite = F.forall(scaled, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    label = F.col("label").cast("long")
    rows = embeddings.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), scaled.alias("scaled"), finite.alias("finite"))

    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2)
            floors = pa.ListArray.from_arrays(pa.array(_offsets(v), pa.int32()), pa.array(np.floor(v.flatten().to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), floors], ["vec_id", "label", "vector"])

    return rows.where("finite").drop("finite").mapInArrow(rounded, "vec_id long, label long, vector array<double>")


def _offsets(column: pa.ListArray) -> np.ndarray:
    o = column.offsets.to_numpy()
    return o - o[0]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``a`` and ``b``."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    tall = lambda m: np.abs(m).max(1)
    x, y = tall(a), tall(b)
    if x.max() * y.max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    small, out = np.outer(x, y) * a.shape[1] < EXACT, np.empty((len(a), len(b)), np.int64)
    plain = np.where(small, np.clip(a, -EXACT, EXACT) @ np.clip(b, -EXACT, EXACT).T, 0.0)
    out[small] = plain[small].astype(np.int64)
    for i, j in zip(*np.nonzero(~small)):
        out[i, j] = max(-MOST, min(MOST, sum(int(p) * int(q) for p, q in zip(a[i].tolist(), b[j].tolist()))))
    return out


def vectors(column: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have vectors of this length, and those."""
    o = _offsets(column)
    mine = np.flatnonzero(np.diff(o) == size)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(mine) == len(column):
        return mine, flat.reshape(len(mine), size)
    return mine, flat[o[mine][:, None] + np.arange(size)]


@dataclass
class Anchors:
    """A block of anchors of one vector length."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    def scored(self, b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, labels, scores by anchor and row) of some of a batch's rows at a time."""
        size = self.vectors.shape[1]
        for first in range(0, b.num_rows, ROWS):
            part = b.slice(first, ROWS)
            mine, v = vectors(part.column(2), size)
            if len(mine):
                yield part.column(0).to_numpy()[mine], part.column(1).to_numpy()[mine], products(self.vectors, v)


@dataclass
class Windows:
    """Selections of the ``k`` highest of an anchor's scores in ranges; arrays are by anchor and window.

    Scores above ``high`` of the range that is open have been counted into ``k`` already; ``by_id`` tells that one score is
    left and ids are being told apart.
    """

    k: np.ndarray
    low: np.ndarray
    high: np.ndarray
    top: np.ndarray
    same_label: bool
    id_low: int
    id_high: int

    def __post_init__(self):
        shape = self.low.shape
        self.by_id = np.zeros(shape, bool)
        self.first, self.last = np.full(shape, self.id_low), np.full(shape, self.id_high)
        self.open = (self.low <= self.high) & (self.k > 0)
        self.empty = ~self.open
        self.cut, self.cut_id = self.low.copy(), np.full(shape, self.id_high)

    def shifts(self) -> np.ndarray:
        """How many bits each open range has below its next digit."""
        spans = np.where(self.by_id, self.last - self.first, self.high - self.low)
        return np.array([max(0, int(s).bit_length() - DIGIT) for s in spans.ravel()]).reshape(spans.shape)

    def candidates(self, anchors: Anchors, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and score of the pairs of the right labels in each anchor's range."""
        same = anchors.labels[:, None] == labels[None, :]
        fits = same & (anchors.ids[:, None] != ids[None, :]) if self.same_label else ~same
        a, r = np.nonzero(fits & (scores >= least[:, None]) & (scores <= most[:, None]))
        return a, r, scores[a, r]

    def histogram(self, rows: DataFrame, anchors: Anchors) -> DataFrame:
        """w, bucket, n over all rows, for the open windows."""
        shifts, width = self.shifts(), self.low.shape[1]
        least = np.where(self.open, self.low, MOST).min(1)
        most = np.where(self.open, self.high, -MOST).max(1)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((self.low.size, 1 << DIGIT), np.int64)
            for b in batches:
                for ids, labels, scores in anchors.scored(b):
                    a, r, s = self.candidates(anchors, ids, labels, scores, least, most)
                    for j in range(width):
                        by_id = self.by_id[a, j]
                        hit = self.open[a, j] & (s >= self.low[a, j]) & (s <= self.high[a, j]) & (~by_id | (ids[r] >= self.first[a, j]) & (ids[r] <= self.last[a, j]))
                        a_, r_, s_, by_id = a[hit], r[hit], s[hit], by_id[hit]
                        bucket = np.where(by_id, ids[r_] - self.first[a_, j], self.high[a_, j] - s_) >> shifts[a_, j]
                        place, n = np.unique((a_ * width + j) << DIGIT | bucket, return_counts=True)
                        sums.reshape(-1)[place] += n
            w, bucket = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(bucket), pa.array(sums[w, bucket])], ["w", "bucket", "n"])

        return rows.mapInArrow(count, "w long, bucket long, n long").groupBy("w", "bucket").agg(F.sum("n").alias("n"))

    def narrow(self, counted: DataFrame) -> None:
        """Takes each open window to the bucket of its kth score."""
        order = Window.partitionBy("w").orderBy("bucket")
        wanted = counted.sparkSession.createDataFrame([(int(w), int(k)) for w, k in zip(np.flatnonzero(self.open), self.k[self.open])], "w long, k long")
        upto = counted.withColumn("upto", F.sum("n").over(order)).join(F.broadcast(wanted), "w")
        found = upto.where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k"))).select("w", "bucket", "n", (F.col("upto") - F.col("n")).alias("before")).toArrow()
        shifts = self.shifts()
        still = np.zeros_like(self.open)
        for w, bucket, n, before in zip(*(found[c].to_pylist() for c in ("w", "bucket", "n", "before"))):
            at = np.unravel_index(w, self.low.shape)
            shift = int(shifts[at])
            self.k[at] -= before
            if self.by_id[at]:
                self.first[at] += bucket << shift
                self.last[at] = min(int(self.last[at]), int(self.first[at]) + (1 << shift) - 1)
                self.cut_id[at] = self.last[at]
                still[at] = shift > 0 and before + n > LEFT
                continue
            self.high[at] -= bucket << shift
            self.low[at] = max(int(self.low[at]), int(self.high[at]) - (1 << shift) + 1)
            self.cut[at] = self.low[at]
            still[at] = before + n > LEFT
            if still[at] and shift == 0:
                self.by_id[at] = True
        self.open = still  # windows with fewer rows than k keep their whole range

    def gather(self, rows: DataFrame, anchors: Anchors) -> DataFrame:
        """w, score, id, n of the pairs at or above the cuts, equal ones counted."""
        width = self.low.shape[1]
        least, most = np.where(self.empty, MOST, self.cut).min(1), np.where(self.empty, -MOST, self.top).max(1)

        def qualifying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ids, labels, scores in anchors.scored(b):
                    a, r, s = self.candidates(anchors, ids, labels, scores, least, most)
                    for j in range(width):
                        hit = ~self.empty[a, j] & (s <= self.top[a, j]) & ((s > self.cut[a, j]) | (s == self.cut[a, j]) & (ids[r] <= self.cut_id[a, j]))
                        found, n = np.unique(np.stack([a[hit] * width + j, s[hit], ids[r[hit]]]), axis=1, return_counts=True)
                        if len(n):
                            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in found), pa.array(n)], ["w", "score", "id", "n"])

        return rows.mapInArrow(qualifying, "w long, score long, id long, n long").groupBy("w", "score", "id").agg(F.sum("n").alias("n"))

    def select(self, rows: DataFrame, anchors: Anchors, k: int) -> DataFrame:
        """w, rank, id, score of each window's first ``k`` rows, by falling score, then id."""
        while self.open.any():
            self.narrow(self.histogram(rows, anchors))
        each = self.gather(rows, anchors).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int"))))
        rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "id", "copy"))
        return each.select("w", rank.alias("rank"), "id", "score").where(F.col("rank") <= k)


def windows(k: int, low: np.ndarray, high: np.ndarray, same_label: bool, ids: tuple[int, int]) -> Windows:
    return Windows(np.full(low.shape, k), low.copy(), high.copy(), high.copy(), same_label, *ids)


def mined(spark: SparkSession, rows: DataFrame, anchors: Anchors, reach: float, ids: tuple[int, int]) -> DataFrame:
    """The hard negatives of one block. ``reach``: the greatest length of a vector; ``ids``: the least and the greatest id."""
    bound = np.minimum(np.ceil(np.sqrt((anchors.vectors**2).sum(1)) * reach * (1 + 1e-9)) + 1, float(MOST)).astype(np.int64)[:, None]
    positives = windows(POSITIVES, -bound, bound, True, ids).select(rows, anchors, POSITIVES).toArrow()
    places = [(w, rank - 1, i, s) for w, rank, i, s in zip(*(positives[c].to_pylist() for c in ("w", "rank", "id", "score")))]
    low, high = np.zeros((len(anchors.ids), POSITIVES), np.int64), np.full((len(anchors.ids), POSITIVES), -1)
    for a, j, _, s in places:
        low[a, j], high[a, j] = -(-LOWEST * s // 100), HIGHEST * s // 100
    pairs = spark.createDataFrame([(a * POSITIVES + j, int(anchors.ids[a]), i, s) for a, j, i, s in places], "w long, anchor_id long, positive_id long, positive_score long")
    found = windows(NEGATIVES, low, high, False, ids).select(rows, anchors, NEGATIVES)
    return found.join(F.broadcast(pairs), "w").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(rows: DataFrame, every: int = 100) -> DataFrame:
    """Hard negatives of the anchors, the rows whose vec_id is divisible by ``every``, among all ``prepared`` rows."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write(rows, "negatives-rows")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    ids_low, ids_high, longest = rows.agg(F.min("vec_id"), F.max("vec_id"), F.max(square)).first()
    anchors = rows.where(F.col("vec_id") % every == 0).distinct()
    sizes = anchors.groupBy(F.size("vector").alias("size")).count().collect()  # a row for each length of vectors
    anchors = scratch.write(anchors.withColumn("at", F.xxhash64("vec_id", "label", "vector")), "negatives-anchors")
    path = new_dir(spark, "negatives")
    spark.createDataFrame([], OUT).write.parquet(path)
    for size, n in sizes:
        blocks = -(-n // BLOCK)
        for block in range(blocks):
            mine_ = anchors.where((F.size("vector") == size) & (F.pmod("at", F.lit(blocks)) == block)).orderBy("vec_id", "at").toArrow()
            if not len(mine_):
                continue
            v = np.array(mine_["vector"].to_pylist(), np.float64).reshape(len(mine_), size)
            held = Anchors(mine_["vec_id"].to_numpy(), mine_["label"].to_numpy(), v)
            mined(spark, rows, held, float(np.sqrt(longest)), (ids_low, ids_high)).write.mode("append").parquet(path)
    scratch.drop_all()
    return spark.read.schema(OUT).parquet(path)
