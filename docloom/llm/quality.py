"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from one Arrow pass over the whole texts. The trees are grown in numpy on a bounded sample of
labelled rows and flattened into arrays, so that scoring walks all rows of a batch down one tree at a time.

Defined results: a null text counts as empty; an empty text has all-zero statistics and a score like any other; a
document without a label is scored and never trained on; labels other than 0 and 1, or null, are ignored; of several
labels for one id the largest counts; repeated document rows are scored once each; without usable labels every score
is 0.5. Columns of ``documents`` other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import docs_only, fold, materialize

#: Labelled rows that the trees are fitted on, at most; those with the smallest hash of their id.
MAX_LABELLED = 20_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS, L2 = 60, 4, 32, 0.15, 10, 1.0
HELD_OUT_FOLD = 0
THRESHOLD = 0.3

STATS = (
    "log_chars", "log_words", "word_len", "word_len_sd", "symbols", "bars", "stops", "commas", "bangs", "digits",
    "upper", "wide", "line_words", "dup_lines", "distinct_words", "top_word", "top_share5", "short_words",
    "long_words", "bare_words", "sentence_words", "brackets", "repeat_pairs", "first_upper",
)

_KINDS = {"symbols": b"#*$%&<>", "bars": b"|", "stops": b".", "commas": b",;:", "bangs": b"!?", "brackets": b"()[]{}\"'"}
_SPACE = b" \t\n\x0b\x0c\r"


def _classes() -> tuple[np.ndarray, dict[str, int]]:
    """A class for each byte value, and the class numbers."""
    names = [*_KINDS, "digits", "upper", "lower", "wide", "space", "tail", "other"]
    at = {n: i for i, n in enumerate(names)}
    lut = np.full(256, at["other"], np.uint8)
    for n, chars in _KINDS.items():
        lut[list(chars)] = at[n]
    lut[48:58], lut[65:91], lut[97:123] = at["digits"], at["upper"], at["lower"]
    lut[128:192], lut[192:] = at["tail"], at["wide"]
    lut[list(_SPACE)] = at["space"]
    return lut, at


_LUT, _AT = _classes()


def statistics(text: str) -> list[float]:
    """The statistics of one whole text, in the order of STATS."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATS)
    data = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(_LUT[data], minlength=len(_AT))
    chars = len(raw) - int(kinds[_AT["tail"]])
    ink = max(1, chars - int(kinds[_AT["space"]]))
    share = lambda k: float(kinds[_AT[k]]) / ink
    lens = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen = Counter(words)
    top = [c for _, c in seen.most_common(5)]
    bare = sum(not w.isalnum() and w.isascii() and not any(65 <= b <= 90 or 97 <= b <= 122 for b in w) for w in seen)
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 0
    return [
        float(np.log1p(chars)), float(np.log1p(n)), float(lens.mean()), float(lens.std()), share("symbols"), share("bars"),
        share("stops"), share("commas"), share("bangs"), share("digits"), share("upper"), share("wide"), n / len(lines),
        1 - len(set(lines)) / len(lines), len(seen) / n, top[0] / n, sum(top) / n, float((lens <= 3).mean()),
        float((lens >= 12).mean()), bare / n, n / (1 + int(kinds[_AT["stops"]]) + int(kinds[_AT["bangs"]])), share("brackets"),
        1 - pairs / max(1, n - 1), sum(65 <= w[0] <= 90 for w in words) / n,
    ]


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = np.array([statistics(x) for x in b.column(1).to_pylist()], np.float64).reshape(-1, len(STATS))
        cols = [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(STATS))]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *STATS])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text."""
    return docs_only(docs).mapInArrow(_stats_batches, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


class Trees:
    """Boosted trees as flat arrays: for node i its statistic, cut, left child (right is the next), and leaf value."""

    def __init__(self, stat: np.ndarray, cut: np.ndarray, left: np.ndarray, value: np.ndarray, roots: np.ndarray, bias: float):
        self.stat, self.cut, self.left, self.value, self.roots, self.bias = stat, cut, left, value, roots, bias

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                left = self.left[at]
                goes = np.where(left < 0, 0, (x[rows, self.stat[at]] > self.cut[at]).astype(np.int64))
                at = np.where(left < 0, at, left + goes)
            out += self.value[at]
        return 1 / (1 + np.exp(-out))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Second-order boosting on binned statistics; a level at a time, one histogram of (node, statistic, bin)."""
    n, f = x.shape if len(x) else (0, len(STATS))
    if not n or y.min() == y.max():
        bias = 0.0 if not n else float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        return Trees(np.zeros(1, int), np.zeros(1), np.full(1, -1), np.zeros(1), np.zeros(1, int), bias)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    p0 = y.mean()
    bias = float(np.log(p0 / (1 - p0)))
    margin = np.full(n, bias)
    stat, cut, left, value, roots = [], [], [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        base = len(stat)
        roots.append(base)
        for a, v in ((stat, 0), (cut, 0.0), (left, -1), (value, 0.0)):
            a.append(v)
        at, level = np.full(n, base), [base]
        for depth in range(DEPTH + 1):
            where = {node: i for i, node in enumerate(level)}
            live = np.isin(at, level)
            k = np.vectorize(where.get, otypes=[int])(at[live]) if live.any() else np.zeros(0, int)
            m = len(level)
            tot_g, tot_h = np.bincount(k, g[live], m), np.bincount(k, h[live], m)
            for i, node in enumerate(level):
                value[node] = float(-RATE * tot_g[i] / (tot_h[i] + L2))
            if depth == DEPTH:
                break
            best = [(1e-6, -1, -1)] * m
            for j in range(f):
                key = k * BINS + binned[live, j]
                hg, hh, hc = (np.bincount(key, w, m * BINS).reshape(m, BINS).cumsum(1) for w in (g[live], h[live], np.ones(len(k))))
                gain = hg**2 / (hh + L2) + (tot_g[:, None] - hg) ** 2 / (tot_h[:, None] - hh + L2) - (tot_g**2 / (tot_h + L2))[:, None]
                gain[(hc < LEAST_ROWS) | (hc[:, -1:] - hc < LEAST_ROWS)] = -1
                gain[:, len(cuts[j]) :] = -1
                for i, b in enumerate(gain.argmax(1)):
                    if gain[i, b] > best[i][0]:
                        best[i] = (float(gain[i, b]), j, int(b))
            below = []
            for i, node in enumerate(level):
                _, j, b = best[i]
                if j < 0:
                    continue
                stat[node], cut[node], left[node] = j, float(cuts[j][b]), len(stat)
                for _ in (0, 1):
                    below.append(len(stat))
                    for a, v in ((stat, 0), (cut, 0.0), (left, -1), (value, 0.0)):
                        a.append(v)
                mine = at == node
                at[mine] = left[node] + (binned[mine, j] > b)
            if not (level := below):
                break
        margin += np.array(value)[at]
    return Trees(np.array(stat), np.array(cut), np.array(left), np.array(value), np.array(roots), bias)


def marked(labels: DataFrame, held_out_fold: int = HELD_OUT_FOLD, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, y) of at most ``most`` labelled ids outside the held-out fold, by the smallest hash of the id."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & (fold(F.col("doc_id")) != held_out_fold))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )


def labelled_sample(stats: DataFrame, marks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and quality of the marked ids."""
    least = F.min(F.struct(*STATS)).alias("s")  # of rows with one id always the same
    rows = stats.join(F.broadcast(marks), "doc_id").groupBy("doc_id", "y").agg(least).select("doc_id", "y", "s.*").orderBy("doc_id").toPandas()  # bounded as the marks are
    return rows[list(STATS)].to_numpy(np.float64), rows["y"].to_numpy(np.float64)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document row."""
    stats = materialize(document_statistics(docs), "quality-stats")
    x, y = labelled_sample(stats, marked(labels))
    trees = fit_trees(x, y)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.score(rows))], ["doc_id", "score"])

    scored = stats.mapInArrow(batches, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The document rows whose score reaches the threshold, with their own columns.

    Texts are judged where they are read: no row is shuffled, and only the marked rows are read twice.
    """
    marks = materialize(marked(labels), "quality-marks")
    sample = docs_only(docs).join(F.broadcast(marks.select("doc_id")), "doc_id")
    trees = fit_trees(*labelled_sample(document_statistics(sample), marks))

    def scores(texts: pd.Series) -> pd.Series:
        rows = np.array([statistics(x or "") for x in texts], np.float64).reshape(-1, len(STATS))
        return pd.Series(trees.score(rows))

    score = F.pandas_udf(scores, "double")
    return docs.where(score(F.coalesce("text", F.lit(""))) >= threshold)
