"""LM scoring: corpus counts, a unigram score, and a gated recurrent language model's log-likelihood of whole texts.

1. Word counts of all training documents: counted in each task, summed by word.
2. The ``HEAD`` most frequent words (of at most ``LONGEST`` bytes) go to every worker; all other words stay in a table
   and meet the documents in a join, so no vocabulary is cut off and no frequent word is shuffled.
3. Words outside the recurrent model's vocabulary are the unknown word there. Which one it is, is given by a mixture of
   their counts and of a byte model of order three over all of them, so that every text has a proper probability.
4. The recurrent model is started on a bounded sample on the driver, then trained in every task on all windows of all
   the task's training documents, the state carried from window to window; the replicas' weights are averaged by their
   numbers of windows, up to ``FAN_IN`` in a group at a time.
5. All documents are scored whole, the state carried from window to window.

Defined results: a null text counts as empty, whose tokens are the end alone; a row without an id is never trained on
and not held out; repeated rows each count and are each scored; with no training row all counts are 0. Columns other
than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import gru
from docloom.llm.common import docs_only, fold, materialize
from docloom.llm.words import HashTable, parts, text_bytes, word_hashes, word_places

HELD_OUT_FOLD = 1
HEAD, LONGEST = 250_000, 64
#: Half of two to this power is how many words a task counts before it passes them on.
COUNTED_BITS = 20
#: Documents that the recurrent model is started on, at most, how often, and how many side by side.
START_DOCS, START_ROUNDS, START_BATCH, START_RATE, RATE = 400, 2, 64, 0.1, 0.03
FAN_IN = 32
#: Bytes of text whose words are found at once, and those that the recurrent model scores side by side, unless one text is longer.
SCORED_BYTES, BESIDE_BYTES = 1 << 22, 1 << 24
CONTEXTS, SYMBOLS = 1 << 14, 257  # 256: the word's end
#: Of an unknown word's probability so much comes from its spelling, the rest from its share of the unknown words counted.
SPELLED = 0.3


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """The hashes of a column's words, each text's first, the lower-cased bytes, and where the words start and end there."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_places(data, offsets)
    return np.maximum(word_hashes(data, starts, ends), np.uint64(1)), first, data.tobytes().lower(), starts, ends


def _counts_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(times[: len(seen)])], ["word", "c"])

    seen: list[bytes] = []
    index, times = HashTable(COUNTED_BITS), np.zeros(1 << COUNTED_BITS, np.int64)
    for b in batches:
        for _, part in parts(b.column(0)):
            hashes, _, raw, starts, ends = _words(part)
            places = index.find(hashes)
            there = places[places >= 0]
            times[: len(seen)] += np.bincount(there, minlength=len(seen)) if len(seen) else 0
            new, where, n = np.unique(hashes[places < 0], return_index=True, return_counts=True)
            where = np.flatnonzero(places < 0)[where]
            if len(seen) + len(new) > len(times) // 2:
                yield rows()
                seen, index = [], HashTable(max(COUNTED_BITS, (2 * len(new)).bit_length()))
                times = np.zeros(len(index.keys), np.int64)
            index.put(new, np.arange(len(seen), len(seen) + len(new)))
            times[len(seen) : len(seen) + len(new)] = n
            seen += [raw[a:e] for a, e in zip(starts[where].tolist(), ends[where].tolist())]
    if seen:
        yield rows()


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c) over all training texts."""
    return training.select("text").mapInArrow(_counts_batches, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame) -> DataFrame:
    """The words of the highest counts, as many whole counts as come to HEAD words at most.

    Found from the numbers of words of each count, so that no task or driver sees more than that.
    """
    short = counts.where(F.octet_length("word") <= LONGEST)
    by_count = short.groupBy("c").agg(F.count("*").alias("n"))
    above = by_count.withColumn("words", F.sum("n").over(Window.orderBy(F.desc("c"))))  # a row a count
    least = above.where(F.col("words") <= HEAD).agg(F.min("c")).first()[0]
    return short.where(F.col("c") >= F.lit(least)) if least is not None else short.limit(0)


def _contexts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of words in a row (each with 256 at its end): the hashed three symbols before, 256 before the start."""
    before, key = raw, np.zeros(len(raw), np.int64)
    for _ in range(3):
        before = np.concatenate([[256], before[:-1]])
        before[starts] = 256
        key = key * 1_000_003 + before + 1
    key = (key ^ (key >> 17)) * 0x5851F42D4C957F2D
    return (key >> 40) & (CONTEXTS - 1)


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]]) if len(words) else np.zeros(0, np.int64)
    raw = np.zeros(int(lens.sum()), np.int64)
    ends = starts + lens - 1
    inside = np.ones(len(raw), bool)
    inside[ends] = False
    raw[inside] = np.frombuffer(b"".join(words), np.uint8)
    raw[ends] = 256
    return raw, starts


def _spelling_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CONTEXTS * SYMBOLS, np.int64)
    for b in batches:
        for at in range(0, b.num_rows, 20_000):
            part = b.slice(at, 20_000)
            words = [w.encode() for w in part.column(0).to_pylist()]
            raw, starts = _joined(words)
            context = _contexts(raw, starts)
            weight = np.repeat(part.column(1).to_numpy(), np.diff(np.append(starts, len(raw))))
            total += np.bincount(context * SYMBOLS + raw, weight, len(total)).astype(np.int64)
    at = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["cell", "n"])


class Spelling:
    """log10 p(word) by its bytes: order three (hashed), backed by order none."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray):
        table = np.zeros((CONTEXTS, SYMBOLS))
        table.ravel()[cells] = counts
        plain = (table.sum(0) + 1) / (table.sum() + SYMBOLS)
        self.log = np.log10((table + 8 * plain) / (table.sum(1, keepdims=True) + 8)).astype(np.float32)

    def score(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        raw, starts = _joined(words)
        context = _contexts(raw, starts)
        return np.add.reduceat(self.log[context, raw].astype(np.float64), starts)


class Tables:
    """What every worker holds: the frequent words with their counts, the spelling, the recurrent model's weights."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, ends: int, spelling: Spelling, weights: np.ndarray | None):
        joined = pa.array([w.decode() for w in words], pa.string())
        data, offsets = text_bytes(joined)
        self.index = HashTable(max(4, (2 * len(words)).bit_length()))
        self.index.put(np.maximum(word_hashes(data, offsets[:-1], offsets[1:]), np.uint64(1)), np.arange(len(words)))
        self.total, self.ends = total, ends
        self.below = total + 0.5 * (distinct + 1)
        self.base = np.log10((counts + 0.5) / self.below) if self.below else np.zeros(0)
        self.spelling = spelling
        self.weights = weights
        # numbers of the recurrent model: the end, the unknown word, then the most frequent words
        self.number = np.full(len(words) + 1, gru.UNKNOWN, np.int32)
        n = min(len(words), gru.VOCAB - 2)
        self.number[:n] = np.arange(2, n + 2)
        self.unknown = max(1, total - ends - int(counts[:n].sum()))  # tokens of training that the model doesn't number
        spelled = np.concatenate([spelling.score(words[i : i + 20_000]) for i in range(0, len(words), 20_000)] or [np.zeros(0)])
        self.inside = np.log10(SPELLED * 10.0**spelled + (1 - SPELLED) * counts / self.unknown)

    def numbers(self, column: pa.Array) -> list[np.ndarray]:
        """Each text's words as the recurrent model's numbers, the end last."""
        hashes, first, *_ = _words(column)
        return self.numbered(self.index.find(hashes), first)

    def numbered(self, places: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        line = np.insert(self.number[places], first[1:], gru.END)
        bounds = (first + np.arange(len(first))).tolist()
        return [line[a:b] for a, b in zip(bounds, bounds[1:])]


def _train_batches(tables: Tables):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = gru.Gru(tables.weights)
        windows = model.train_all((d for b in it for _, part in parts(b.column(0)) for d in tables.numbers(part)), RATE)
        if windows:
            yield pa.RecordBatch.from_arrays([pa.array([windows], pa.int64()), pa.array([model.flat().tobytes()], pa.binary())], ["n", "weights"])

    return batches


def _mean(rows: list[tuple[int, bytes]]) -> tuple[int, np.ndarray]:
    n = sum(k for k, _ in rows)
    return n, sum((np.frombuffer(w, np.float32) * np.float32(k / n) for k, w in rows))


def averaged(replicas: DataFrame) -> np.ndarray | None:
    """The replicas' mean weights: groups of FAN_IN at a time, until one group is left."""

    def group(t: pa.Table) -> pa.Table:
        n, w = _mean(list(zip(t.column("n").to_pylist(), t.column("weights").to_pylist())))
        return pa.table({"n": pa.array([n], pa.int64()), "weights": pa.array([w.astype(np.float32).tobytes()], pa.binary())})

    now = materialize(replicas.withColumn("at", F.monotonically_increasing_id()), "gru-weights")
    while (count := now.count()) > FAN_IN:
        groups = -(-count // FAN_IN)
        now = materialize(now.groupBy(F.pmod(F.xxhash64("at"), F.lit(groups)).alias("g")).applyInArrow(group, "n long, weights binary").withColumn("at", F.monotonically_increasing_id()), "gru-weights")
    rows = [(r["n"], bytes(r["weights"])) for r in now.collect()]  # FAN_IN at most
    return _mean(rows)[1] if rows else None


SCORED = "doc_id long, n_tokens long, known double, base double, score double, rare array<struct<word:string,n:long,spelled:double>>"


def _score_batches(tables: Tables):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = gru.Gru(tables.weights)
        end_base = math.log10((tables.ends + 0.5) / tables.below) if tables.below else 0.0

        def scored(waiting: list[tuple[list[pa.Array], list[np.ndarray], np.ndarray, pa.Array]]) -> Iterator[pa.RecordBatch]:
            """The parts whose texts wait for the recurrent model, scored together."""
            every, at = model.score([d for _, numbered, *_ in waiting for d in numbered]) / math.log(10), 0
            for cols, numbered, outside, lists in waiting:
                score = pa.array(every[at : at + len(numbered)] + outside)
                at += len(numbered)
                yield pa.RecordBatch.from_arrays([*cols, score, lists], ["doc_id", "n_tokens", "known", "base", "score", "rare"])

        waiting, size = [], 0
        for b in it:
            for at, texts in parts(b.column(1), SCORED_BYTES):
                hashes, first, raw, starts, ends = _words(texts)
                n = len(texts)
                doc = np.repeat(np.arange(n), np.diff(first))
                places = tables.index.find(hashes)
                total = lambda rows, values: np.bincount(doc[rows], values, n)
                common, out = np.flatnonzero(places >= 0), np.flatnonzero(places >= gru.VOCAB - 2)
                base = total(common, tables.base[places[common]]) + end_base
                known = np.bincount(doc[common], minlength=n) + float(tables.ends > 0)
                # the words that the table lacks, each once a text
                rare = np.flatnonzero(places < 0)
                kinds, where, kind = np.unique(hashes[rare], return_index=True, return_inverse=True)
                words = [raw[a:e] for a, e in zip(starts[rare[where]].tolist(), ends[rare[where]].tolist())]
                letters = np.concatenate([tables.spelling.score(words[i : i + 20_000]) for i in range(0, len(words), 20_000)] or [np.zeros(0)])
                cells, times = np.unique(doc[rare] * max(1, len(kinds)) + kind, return_counts=True)
                which = cells % max(1, len(kinds))
                offsets = np.searchsorted(cells, np.arange(n + 1) * max(1, len(kinds)))
                spelled = pa.array([w.decode() for w in words], pa.string()).take(pa.array(which))
                fields = [spelled, pa.array(times.astype(np.int64)), pa.array(letters[which])]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["word", "n", "spelled"]))
                ids = b.column(0).take(pa.array(np.arange(at, at + n)))  # copied: a slice would hold the batch with its texts
                cols = [ids, pa.array(np.diff(first) + 1), pa.array(known), pa.array(base)]
                waiting.append((cols, tables.numbered(places, first), total(out, tables.inside[places[out]]), lists))
                size += len(raw)
                if size >= BESIDE_BYTES:
                    yield from scored(waiting)
                    waiting, size = [], 0
        if waiting:
            yield from scored(waiting)

    return batches


def corpus_tables(training: DataFrame, counts: DataFrame) -> Tables:
    """Gathers the frequent words and the spelling, and trains the recurrent model."""
    spark = training.sparkSession
    ends, (rows_total, distinct) = training.count(), counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = frequent(counts).toPandas()  # HEAD rows at most
    head = head.sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    words = [w.encode() for w in head["word"]]
    known = words[: gru.VOCAB - 2]
    rare = counts.join(F.broadcast(spark.createDataFrame([(w.decode(),) for w in known], "known string")), F.col("word") == F.col("known"), "left_anti")
    cells = rare.select("word", "c").mapInArrow(_spelling_batches, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # CONTEXTS * SYMBOLS at most
    spelling = Spelling(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64))
    number = head["c"].to_numpy(np.int64)
    tables = Tables(words, number, int(rows_total) + ends, int(distinct) + (ends > 0), ends, spelling, None)

    model = gru.Gru()
    first = np.zeros(gru.VOCAB)
    first[gru.END], first[gru.UNKNOWN] = ends, int(rows_total) - int(number[: len(known)].sum())
    first[2 : 2 + len(known)] = number[: len(known)]
    model.start_from_counts(first)
    hashed = training.select("text", F.xxhash64("doc_id", "text").alias("h"))  # the same rows however the table lies
    chosen = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(START_DOCS).collect()]
    sample = hashed.where(F.col("h").isin(chosen)).dropDuplicates(["h"]).collect()
    texts = pa.array([r["text"] for r in sorted(sample, key=lambda r: r["h"])], pa.string())
    for _ in range(START_ROUNDS):
        model.train_all((d for _, part in parts(texts) for d in tables.numbers(part)), START_RATE, START_BATCH)
    tables.weights = model.flat()
    if ends:
        shared = spark.sparkContext.broadcast(tables)
        replicas = training.select("text").mapInArrow(lambda it: _train_batches(shared.value)(it), "n long, weights binary")
        mean = averaged(replicas)
        tables.weights = mean if mean is not None else tables.weights
    return tables


def unknown_log10(spelled: Column, c: Column, unknown: int) -> Column:
    """log10 of an unknown word's probability by its spelling's log10 and its count, however small."""
    by_letters = F.lit(math.log10(SPELLED)) + spelled
    by_count = F.log10(F.lit((1 - SPELLED) / unknown) * c)
    both = F.greatest(by_letters, by_count) + F.log1p(F.pow(F.lit(10.0), -F.abs(by_letters - by_count))) / math.log(10)
    return F.when(c > 0, both).otherwise(by_letters)


def score_corpus(docs: DataFrame, held_out_fold: int = HELD_OUT_FOLD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document row."""
    docs = docs_only(docs)
    training = docs.where(fold(F.col("doc_id")) != held_out_fold)
    counts = materialize(word_counts(training), "lm-counts")
    tables = corpus_tables(training, counts)
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    scored = materialize(docs.mapInArrow(lambda it: _score_batches(shared.value)(it), SCORED).withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n", "x.spelled")
    found = rare.join(counts, "word", "left")
    below = tables.below or 1.0
    c = F.coalesce("c", F.lit(0))
    inside = unknown_log10(F.col("spelled"), c, tables.unknown)
    sums = found.groupBy("row").agg(
        F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(below))).alias("rare_base"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * inside).alias("rare_score"),
    )
    return scored.join(sums, "row", "left").select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == held_out_fold, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"), F.lit(tables.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
