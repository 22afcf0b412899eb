"""Language identification by interpolated Kneser-Ney character models.

Every language has a model of ``ORDER`` characters: the highest order uses counts, the lower ones the number of different
characters seen before a gram, each discounted by its count of counts and interpolated down to a uniform choice among the
characters known. A model is sorted arrays of 64-bit gram hashes with their discounted shares, and of context hashes with
what is left to lower orders. A text, lower-cased, with every run of anything but letters and marks as one space, gets the
language of the lowest cross-entropy in bits a character. Each different gram of a batch is looked up once.

The fit takes, for each language, at most ``MOST_TEXTS`` different texts outside the held-out fold and stops at ``MOST_CHARS``
characters (the text that reaches it is taken whole), by least hash of the text: a bounded sample of labelled rows, which
bounds the models too. Calibration: models of some folds judge texts of another; a logistic curve over the lead on the second
best (or on the uniform choice) and the length gives ``score``, the probability of being right, and a high quantile of
each language's cross-entropies gives the limit above which a text is not ``accepted``.

A null text, one without a letter, or any text where nothing could be learnt: ``und``, score 0, not accepted. Rows with a
null lang teach nothing; an empty lang is a language. Rows without doc_id are not held out; they may teach. Equal texts of
one language teach once. An empty table gives no rows; other columns are ignored; very long texts are judged whole, one at
a time.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, fold
from docloom.llm.words import K1, K2, K3, mix, parts

ORDER = 5
HELD_OUT_FOLD, CALIBRATION_FOLD = 0, 4
MOST_TEXTS, MOST_CHARS = 1000, 4_000_000
#: Share of a language's own texts that may lie above its limit.
REJECTED = 0.005
UNKNOWN = "und"
COUNTS = "lang string, k int, h long, suffix long, context long, n long"


@lru_cache(1)
def _kept_chars() -> np.ndarray:
    """Which code points are letters or marks."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the reduced texts end to end, each after ``ORDER`` - 1 spaces and closed by one, and each one's first, the end last.

    A text without letters and marks is empty.
    """
    kept, out, sizes = _kept_chars(), [], []
    for text in texts:
        x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        ink = kept[x]
        if not ink.any():
            sizes.append(0)
            continue
        x = np.where(ink, x, np.uint32(0x20))
        x = x[ink | np.concatenate([[False], ink[:-1]])]  # the first of every run of gaps
        lead = np.full(ORDER - 1, 0x20, np.uint32)
        out += [lead, x] if x[-1] == 0x20 else [lead, x, lead[:1]]
        sizes.append(len(x) + ORDER - 1 + (x[-1] != 0x20))
    return np.concatenate([np.zeros(0, np.uint32), *out]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def predicted(starts: np.ndarray) -> np.ndarray:
    """The places of the characters that are predicted: all but the spaces before each text."""
    sizes = np.diff(starts)
    inside = np.ones(starts[-1], bool)
    for i in range(ORDER - 1):
        inside[starts[:-1][sizes > 0] + i] = False
    return np.flatnonzero(inside)


def grams(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` characters that end at each place; 0 for none."""
    if k == 0:
        return np.zeros(len(at), np.uint64)
    low, high = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for i in range(k):
        c = x[at - i].astype(np.uint64)
        if i < 3:
            low |= c << np.uint64(21 * i)
        else:
            high |= c << np.uint64(21 * (i - 3))
    return np.maximum(mix(low * K1 + high * K2 + np.uint64(k * int(K3) & (1 << 64) - 1)), np.uint64(1))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs = b.column(0).to_pylist()
        for lang in sorted(set(langs)):
            mine = b.column(1).filter(pa.array([x == lang for x in langs]))
            for _, some in parts(mine):
                x, starts = characters(some.to_pylist())
                at = predicted(starts)
                for k in range(1, ORDER + 1):
                    h, where, n = np.unique(grams(x, at, k), return_index=True, return_counts=True)
                    suffix, context = grams(x, at[where], k - 1), grams(x, at[where] - 1, k - 1)
                    longs = [pa.array(v.view(np.int64)) for v in (h, suffix, context)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(np.full(len(h), k, np.int32)), *longs, pa.array(n.astype(np.int64))], [c.split()[0] for c in COUNTS.split(", ")])


def teaching(docs: DataFrame) -> DataFrame:
    """fold, lang, text and its hash of the rows that may teach."""
    f = F.coalesce(fold(F.col("doc_id")), F.lit(1))
    return docs.select(f.alias("fold"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (f != HELD_OUT_FOLD)).withColumn("h", F.xxhash64("text"))


def sampled(rows: DataFrame, most_texts: int, most_chars: int) -> DataFrame:
    """lang, text: each language's different texts of the least hashes, up to both bounds.

    Hashes alone are ranked, and only those below the height at which twice the bound is expected; texts are fetched for
    those that stay.
    """
    height = F.col("h").cast("double") / 2.0**64 + 0.5
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    low = rows.join(F.broadcast(sizes), "lang").where(height <= F.greatest(F.lit(2.0 * most_texts), F.lit(50.0)) / F.col("n"))
    hashes = low.groupBy("lang", "h").agg(F.max(F.length("text")).alias("size"))
    order = Window.partitionBy("lang").orderBy("h")
    ranked = hashes.select("lang", "h", F.row_number().over(order).alias("place"), (F.sum("size").over(order) - F.col("size")).alias("before"))
    chosen = ranked.where((F.col("place") <= most_texts) & (F.col("before") < most_chars)).select("lang", "h")
    return rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def counts(sample: DataFrame, scratch: Scratch) -> pa.Table:
    """lang, k, h, context, c of every gram: c is its count at the highest order, else in how many ways it is preceded."""
    seen = sample.mapInArrow(_counted, COUNTS).groupBy("lang", "k", "h").agg(F.min("suffix").alias("suffix"), F.min("context").alias("context"), F.sum("n").alias("n"))
    seen = scratch.write(seen, "language-grams")
    ways = seen.where("k > 1").groupBy("lang", (F.col("k") - 1).alias("k"), F.col("suffix").alias("h")).agg(F.count("*").alias("c"))
    lower = seen.where(F.col("k") < ORDER).join(ways, ["lang", "k", "h"]).select("lang", "k", "h", "context", "c")
    return seen.where(F.col("k") == ORDER).select("lang", "k", "h", "context", F.col("n").alias("c")).unionByName(lower).toArrow()


@dataclass
class Kept:
    """Numbers by sorted hashes."""

    keys: np.ndarray
    values: np.ndarray

    def of(self, wanted: np.ndarray, otherwise: float) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(wanted), otherwise)
        i = np.searchsorted(self.keys, wanted)
        i[i == len(self.keys)] = 0
        return np.where(self.keys[i] == wanted, self.values[i], otherwise)


@dataclass
class Models:
    """All languages' models and how far they are to be trusted."""

    langs: list[str] = field(default_factory=list)
    uniform: float = 1.0
    #: By language and order: discounted shares by gram, and what is left to the lower orders by context.
    shares: list[list[Kept]] = field(default_factory=list)
    rests: list[list[Kept]] = field(default_factory=list)
    curve: np.ndarray = field(default_factory=lambda: np.array([0.0, 4.0, 0.5]))
    limits: dict[str, float] = field(default_factory=dict)
    limit: float = np.inf

    def log_shares(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log2 of each language's probability of the characters at these places."""
        h = [grams(x, at, k) for k in range(ORDER + 1)]
        before = [grams(x, at - 1, k) for k in range(ORDER)]
        out = np.empty((len(self.langs), len(at)))
        for n, (shares, rests) in enumerate(zip(self.shares, self.rests)):
            p = np.full(len(at), self.uniform)
            for k in range(1, ORDER + 1):
                p = shares[k - 1].of(h[k], 0.0) + rests[k - 1].of(before[k - 1], 1.0) * p
            out[n] = np.log2(p)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's cross-entropy by language in bits a character, and how many are predicted; without any, not a number."""
        x, starts = characters(texts)
        at = predicted(starts)
        sizes = np.maximum(np.diff(starts) - (ORDER - 1), 0)
        _, where, back = np.unique(grams(x, at, ORDER), return_index=True, return_inverse=True)
        log_p = self.log_shares(x, at[where])
        out = np.full((len(texts), len(self.langs)), np.nan)
        some = sizes > 0
        first = (np.cumsum(sizes) - sizes)[some]
        for n in range(len(self.langs)):
            if some.any():
                out[some, n] = -np.add.reduceat(log_p[n][back], first) / sizes[some]
        return out, sizes

    def judged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each text's language by number, -1 for none, its cross-entropy, its lead and its length."""
        if not self.langs:
            return np.full(len(texts), -1), *(np.full(len(texts), np.nan) for _ in range(2)), np.zeros(len(texts))
        e, sizes = self.entropies(texts)
        none = np.isnan(e[:, 0])
        best = np.where(none, -1, np.where(np.isnan(e), np.inf, e).argmin(1))
        rivals = np.concatenate([e, np.full((len(texts), 1), -np.log2(self.uniform))], 1)
        rivals[np.arange(len(texts)), best] = np.inf
        least = e[np.arange(len(texts)), best]
        return best, least, rivals.min(1) - least, sizes

    def probability(self, lead: np.ndarray, size: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(lead, size) @ self.curve, -30, 30)))


def _features(lead: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(lead)), lead, np.log1p(size) / 4], 1)


def fit(counted: pa.Table) -> Models:
    """Models from the rows of ``counts``."""
    k, c = counted["k"].to_numpy(), counted["c"].to_numpy().astype(np.float64)
    h, context = (counted[name].to_numpy().astype(np.int64).view(np.uint64) for name in ("h", "context"))
    codes = counted["lang"].combine_chunks().dictionary_encode()
    langs = codes.dictionary.to_pylist() if len(codes) else []
    at_lang = codes.indices.to_numpy() if len(codes) else np.zeros(0, np.int64)
    m = Models(uniform=1.0 / (len(np.unique(h[k == 1])) + 1))
    for n in sorted(range(len(langs)), key=langs.__getitem__):
        m.langs.append(langs[n])
        shares, rests = [], []
        for order in range(1, ORDER + 1):
            mine = np.flatnonzero((at_lang == n) & (k == order))
            mine = mine[np.argsort(h[mine])]
            once, twice = (c[mine] == 1).sum(), (c[mine] == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            contexts, back = np.unique(context[mine], return_inverse=True)
            total, kinds = np.bincount(back, c[mine]), np.bincount(back)
            shares.append(Kept(h[mine], (c[mine] - discount) / total[back]))
            rests.append(Kept(contexts, discount * kinds / total))
        m.shares.append(shares)
        m.rests.append(rests)
    return m


def calibrate(m: Models, judge: Models, texts: list[str], langs: list[str]) -> Models:
    """Sets the curve and limits of ``m`` by what ``judge``, which saw none of these texts, makes of them."""
    best, least, lead, size = judge.judged(texts)
    some = best >= 0
    if not some.any():
        return m
    right = np.array([b >= 0 and judge.langs[b] == lang for b, lang in zip(best, langs)])
    x, y, w = _features(lead[some], size[some]), right[some].astype(np.float64), m.curve.copy()
    prior, weight = m.curve, np.diag([0.05, 0.05, 0.05])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + weight, x.T @ (p - y) + weight @ (w - prior))
    m.curve = w
    m.limit = float(np.quantile(least[right], 1 - REJECTED)) if right.any() else np.inf
    for n, lang in enumerate(judge.langs):
        own = right & (best == n)
        if own.any():
            m.limits[lang] = float(np.quantile(least[own], 1 - REJECTED))
    return m


def learn(docs: DataFrame, most_texts: int = MOST_TEXTS, most_chars: int = MOST_CHARS) -> Models:
    """Models from the rows outside the held-out fold, calibrated on one of the folds by models of the others."""
    rows, scratch = teaching(docs), Scratch(docs.sparkSession)
    m = fit(counts(sampled(rows, most_texts, most_chars), scratch))
    judge = fit(counts(sampled(rows.where(F.col("fold") != CALIBRATION_FOLD), most_texts // 2, most_chars // 2), scratch))
    held = sampled(rows.where(F.col("fold") == CALIBRATION_FOLD), most_texts // 2, most_chars // 2).orderBy("lang", "text").toArrow()
    scratch.drop_all()
    return calibrate(m, judge, held["text"].to_pylist(), held["lang"].to_pylist())


def identify(docs: DataFrame, m: Models | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted, bits (a character) of every document row."""
    m = m or learn(docs)
    limits = [m.limits.get(lang, m.limit) for lang in m.langs]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for first, some in parts(b.column(1).fill_null("")):
                texts = some.to_pylist()
                best, least, lead, size = m.judged(texts)
                found = [n if n >= 0 and has_letter(t) else -1 for n, t in zip(best.tolist(), texts)]
                known = np.array(found) >= 0
                score = np.where(known, m.probability(np.nan_to_num(lead), size), 0.0)
                accepted = known & (np.nan_to_num(least) <= np.array([*limits, -np.inf])[found]) & (score >= 0.5)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(texts)), pa.array([m.langs[n] if n >= 0 else UNKNOWN for n in found], pa.string()), pa.array(score), pa.array(accepted), pa.array(np.where(known, least, np.nan), from_pandas=True)],
                    ["doc_id", "lang_pred", "score", "accepted", "bits"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    judged = rows.mapInArrow(batches, "doc_id long, lang_pred string, score double, accepted boolean, bits double")
    return judged.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted", "bits")
