"""Near duplicates: many universal hash minima with banding, signature verification, star-contracted components.

1. One pass gives each text's set of word shingles as 64-bit hashes, its size, a 128-bit digest of the set, the minima
   of ``HASHES`` universal hash functions, of the first ``BANDS * ROWS`` a hash for each band, and a signature: four bits
   of each minimum.
2. Rows of equal sets are one class, found by grouping on the digest; only one row a class goes on. Classes that share a
   band's hash are in one bucket. Buckets of one class go at once, which leaves a small part of the bands' rows, and
   each turn below leaves fewer: a bucket goes when its members have one label.
3. Buckets aren't turned into all their pairs. First every member is paired with the bucket's most central one, the one
   with the most company over its buckets. Then buckets are summed by label, and of each label two members by lot are
   paired with two of the bucket's largest label, as long as that finds links for a hundredth of what it tries.
4. Members that are still apart from their bucket's largest label are compared with all others by signature, inside a
   join that gives each pair once, in the first bucket it shares, and only if its sizes and signatures allow the
   threshold.
5. All pairs are confirmed on the full sets, which are built once. Pairs meet their sets in blocks of ``BLOCK_ROWS`` by
   ``BLOCK_ROWS`` rows of one neighbourhood, so a set is moved once a block, not once a pair. The links' components, by
   alternating large-star and small-star, label the rows.

With 46 bands of 7 a pair at the threshold of 0.8 shares no bucket once in 50,000 cases; its signature falls below the
test, which is ``SIGMAS`` standard deviations below the threshold, once in 30,000.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; a text of fewer words than
a shingle has its whole sequence as one shingle; repeated rows are members of one class, each reported; a row without
an id belongs to its component, whose smallest other id counts; without any, component_id is null and kept true.
Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, docs_only, materialize, may_be_among
from docloom.llm.components import connected_components
from docloom.llm.words import K1, K3, mix, parts, shingle_sets

BANDS, ROWS = 46, 7
HASHES = 960  # minima; the first BANDS * ROWS make the bands, all make the signature
THRESHOLD = (80, 100)
BITS = 4  # of each minimum in the signature
SIGMAS = 4.0
BLOCK_ROWS = 256
CHUNK = 128
#: Lots go on while they link at least one of so many tried pairs.
WORTH = 100


def universal(count: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of the hash functions x -> (a * x + b) mod 2**64 over 32-bit x, whose high half is used."""
    r = np.random.default_rng(20240229)
    return r.integers(0, 1 << 64, count, np.uint64) | np.uint64(1), r.integers(0, 1 << 64, count, np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32))[:, None]
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), CHUNK):
        y = x[i : i + CHUNK] * a
        y += b
        np.minimum(best, y.min(0), out=best)
    return best >> np.uint64(32)


def band_hashes(mins: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hashes of (texts, HASHES) minima."""
    rows = mins[:, : BANDS * ROWS].reshape(len(mins), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * K1, rows.shape[:2])
    for i in range(ROWS):
        h = mix(h ^ rows[:, :, i] * K3)
    return h.view(np.int64)


def packed(mins: np.ndarray) -> np.ndarray:
    """(texts, longs) signatures: the last BITS bits of each minimum, side by side; what is left over is zero."""
    each = 64 // BITS
    low = np.zeros((len(mins), -(-HASHES // each) * each), np.uint64)
    low[:, :HASHES] = mins & np.uint64((1 << BITS) - 1)
    return np.bitwise_or.reduce(low.reshape(len(mins), low.shape[1] // each, each) << (np.arange(each, dtype=np.uint64) * np.uint64(BITS)), 2).view(np.int64)


def least_agreeing(threshold: tuple[int, int], sigmas: float) -> int:
    """So many of the signature's entries agree in a pair at the threshold, less some standard deviations."""
    j = threshold[0] / threshold[1]
    p = j + (1 - j) / (1 << BITS)
    return int(HASHES * p - sigmas * (HASHES * p * (1 - p)) ** 0.5)


def _agreeing(x: Column, y: Column) -> Column:
    """How many entries of two signatures agree."""

    def differ(a: Column, b: Column) -> Column:
        z = a.bitwiseXOR(b)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    return F.lit(HASHES) - F.aggregate(F.zip_with(x, y, differ), F.lit(0), lambda s, n: s + n)


def _sized(x: Column, y: Column, threshold: tuple[int, int]) -> Column:
    return F.lit(threshold[1]) * F.least(x, y) >= F.lit(threshold[0]) * F.greatest(x, y)


def _lists(values: np.ndarray, some: np.ndarray) -> pa.Array:
    """A list a text, null where ``some`` is false; the values are those of the other texts."""
    width = values.shape[1]
    offsets = np.concatenate([[0], np.cumsum(some)]).astype(np.int32) * width
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.ravel()), mask=pa.array(~some))


SIGNED = "doc_id long, text_hash long, size long, key binary, bands array<long>, sketch array<long>"


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, hash of the text, size and digest of the shingle set, band hashes, signature, row number."""
    a, b = universal()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in it:
            for at, texts in parts(batch.column(1)):
                sets = shingle_sets(texts, width)
                some = np.array([len(s) > 0 for s in sets])
                mins = np.array([minima(s, a, b) for s in sets if len(s)], np.uint64).reshape(-1, HASHES)
                keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                cols = [batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), keys]
                yield pa.RecordBatch.from_arrays([*cols, _lists(band_hashes(mins), some), _lists(packed(mins), some)], ["doc_id", "text_hash", "size", "key", "bands", "sketch"])

    made = docs_only(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(batches, SIGNED)
    return made.withColumn("row", F.monotonically_increasing_id())


def _members(filled: DataFrame, classes: DataFrame) -> DataFrame:
    """(band, row) of the classes that share a bucket with another class."""
    each = filled.select("row", F.xxhash64("key").alias("kind"), F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.min("kind").alias("lo"), F.max("kind").alias("hi")).where("lo <> hi").select("band")
    return each.select("band", "row").join(shared, "band", "left_semi").join(classes.select(F.col("rep").alias("row")), "row", "left_semi").select("band", "row")


def _sets(docs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(row, shingles) of rows (row, doc_id, text_hash), built from the texts again."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in it:
            keep = []
            for r in b.column(0).to_pylist():  # repeated rows come one after the other
                keep.append(r != last)
                last = r
            b = b.filter(pa.array(keep, pa.bool_()))
            for at, texts in parts(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array([s.tobytes() for s in shingle_sets(texts, width)], pa.binary())], ["row", "shingles"])

    ids = rows.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("h"), "row")
    texts = may_be_among(docs_only(docs), rows.select("doc_id"))[0].withColumn("text_hash", F.xxhash64("text"))
    return texts.join(ids, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("h"))).select("row", "text").mapInArrow(batches, "row long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Of distinct pairs (a, b, home, blocks) the links (u, v), whose full sets reach the threshold.

    Rows of one home are dealt to blocks; the pairs of two blocks meet the sets of their rows, each moved once.
    """
    num, den = threshold

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {r: np.frombuffer(s.as_buffer(), np.uint64) for r, s in zip(right.column("row").to_pylist(), right.column("shingles"))}
        u, v = [], []
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist()):
            x, y = found[a], found[b]
            if len(x) > len(y):
                x, y = y, x
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            if den * both >= num * (len(x) + len(y) - both):
                u.append(a)
                v.append(b)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
    dealt = pairs.select("home", "blocks", block("a").alias("ba"), block("b").alias("bb"), "a", "b")
    side = lambda c: dealt.select("home", "blocks", "ba", "bb", F.col(c).alias("row")).distinct()
    needed = side("a").unionAll(side("b")).distinct().join(sets, "row")
    needed = needed.select(F.col("home").alias("of"), F.col("blocks").alias("in"), F.col("ba").alias("na"), F.col("bb").alias("nb"), "row", "shingles")
    return dealt.groupBy("home", "blocks", "ba", "bb").cogroup(needed.groupBy("of", "in", "na", "nb")).applyInArrow(compare, "u long, v long")


def _blocks(members: Column) -> Column:
    """Into how many blocks a bucket's members are dealt: a power of two, so that buckets of like size share them."""
    return F.greatest(F.lit(1), F.pow(F.lit(2), F.ceil(F.log2(members / BLOCK_ROWS))).cast("int"))


def _pair(a: Column, b: Column, home: Column) -> Column:
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), home.alias("home"), F.col("blocks"))


def _likely(pairs: DataFrame, rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b, home, blocks) those whose sizes and signatures allow the threshold, each once."""
    side = lambda n: rows.select(F.col("row").alias(n), F.col("size").alias(f"size_{n}"), F.col("sketch").alias(f"sketch_{n}"))
    both = pairs.groupBy("a", "b").agg(F.min(F.struct("home", "blocks")).alias("at")).select("a", "b", "at.*").join(side("a"), "a").join(side("b"), "b")
    allowed = _sized(F.col("size_a"), F.col("size_b"), threshold) & (_agreeing(F.col("sketch_a"), F.col("sketch_b")) >= least_agreeing(threshold, SIGMAS))
    return both.where(allowed).select("a", "b", "home", "blocks")


def _central_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket with the most central one, that with the most company over all its buckets."""
    counted = members.join(members.groupBy("band").agg(F.count("*").alias("n")), "band")
    central = counted.join(counted.groupBy("row").agg(F.sum("n").alias("centre")), "row")
    hubs = central.groupBy("band").agg(F.max_by("row", F.struct("centre", -F.col("row"))).alias("hub"), _blocks(F.max("n")).alias("blocks"))
    return members.join(hubs, "band").where("row <> hub").select(_pair(F.col("row"), F.col("hub"), F.col("hub")).alias("p")).select("p.*")


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, F.col("row") == F.col("vertex"), "left").select("band", "row", F.coalesce("root", "row").alias("label"))


def _met(labelled: DataFrame, turn: int) -> DataFrame:
    """(band, label, r0, r1, main, blocks) of the buckets of several labels: of each label two members by lot, and those of the largest.

    Members are summed by bucket and label, never joined; the lot falls anew in each bucket and turn.
    """
    lot = lambda n: F.min_by("row", F.xxhash64("row", "band", F.lit(2 * turn + n)))
    labels = labelled.groupBy("band", "label").agg(F.count("*").alias("m"), lot(0).alias("r0"), lot(1).alias("r1"))
    mains = labels.groupBy("band").agg(F.count("*").alias("labels"), F.max_by(F.struct("label", "r0", "r1"), F.struct("m", -F.col("label"))).alias("main"), _blocks(F.sum("m")).alias("blocks"))
    return labels.join(mains.where("labels > 1").select("band", "main", "blocks"), "band").select("band", "label", "r0", "r1", "main", "blocks")


def _lots(met: DataFrame) -> DataFrame:
    home = F.col("main.label")
    each = F.array(_pair(F.col("r0"), F.col("main.r0"), home), _pair(F.col("r1"), F.col("main.r1"), home))
    return met.where(F.col("label") != home).select(F.explode(each).alias("p")).select("p.*")


def _apart(labelled: DataFrame, met: DataFrame, rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """All pairs (a, b, home, blocks) of a bucket with different labels whose sizes and signatures allow the threshold, in their first bucket."""
    mains = met.where(F.col("label") == F.col("main.label")).select("band", F.col("main.label").alias("home"), "blocks")
    full = labelled.join(mains, "band").join(rows.select("row", "bands", "size", "sketch"), "row")
    side = lambda n: full.select("home", "blocks", *(F.col(c).alias(f"{n}_{c}") for c in ("band", "row", "label", "bands", "size", "sketch")))
    x, y = side("x").where("x_label <> home"), side("y").drop("home", "blocks")
    new = (F.col("x_label") != F.col("y_label")) & ((F.col("y_label") == F.col("home")) | (F.col("x_row") < F.col("y_row")))
    first = F.array_min(F.array_intersect("x_bands", "y_bands")) == F.col("x_band")
    alike = _agreeing(F.col("x_sketch"), F.col("y_sketch")) >= least_agreeing(threshold, SIGMAS)
    met_ = x.join(y, (F.col("x_band") == F.col("y_band")) & new & _sized(F.col("x_size"), F.col("y_size"), threshold) & first & alike)
    return met_.select(_pair(F.col("x_row"), F.col("y_row"), F.col("home")).alias("p")).select("p.*")


def roots_of(docs: DataFrame, signed: DataFrame, classes: DataFrame, width: int, threshold: tuple[int, int], scratch: Scratch) -> DataFrame:
    """(vertex, root) of class representatives whose component has a smaller one; its links connect what any links connect.

    ``signed`` is dropped once the rows that share a bucket have been taken from it.
    """
    filled = signed.where("size > 0")
    members = scratch.write(_members(filled, classes), "near-members")
    buckets = members.groupBy("row").agg(F.sort_array(F.collect_list("band")).alias("bands"))
    rows = scratch.write(buckets.join(filled.drop("bands", "key"), "row"), "near-rows")
    scratch.drop(signed)
    sets = scratch.write(_sets(docs, rows.select("row", "doc_id", "text_hash"), width), "near-sets")
    tried = scratch.write(_likely(_central_pairs(members), rows, threshold), "near-pairs")
    links = scratch.write(confirmed(tried, sets, threshold), "near-links")
    scratch.release()
    roots = connected_components(links, scratch)
    turn, lots = 0, True
    while True:
        turn += 1
        labelled = scratch.write(_labelled(members, roots), "near-labelled")
        met = scratch.write(_met(labelled, turn), "near-met")
        if met.isEmpty():
            return roots
        left = scratch.write(labelled.join(met.select("band").distinct(), "band", "left_semi"), "near-members")
        if lots:
            pairs = _likely(_lots(met), rows, threshold).join(tried, ["a", "b"], "left_anti")
        else:
            pairs = _apart(left, met, rows, threshold)
        pairs = scratch.write(pairs, "near-pairs")
        found = scratch.write(confirmed(pairs, sets, threshold), "near-links")
        new, n = found.count(), pairs.count()
        if new:
            united = connected_components(roots.toDF("u", "v").unionAll(found), scratch)
            scratch.drop(roots)
            roots = united
        if not lots:
            return roots
        lots = new * WORTH >= n > 0
        scratch.drop(labelled, met, members)
        members = left.select("band", "row")
        tried = tried.unionAll(pairs)
        scratch.release()


ROWS_OUT = ["row", "doc_id", "text_hash", "size", "component", "component_id"]


def near_rows(docs: DataFrame, width: int, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """row, doc_id, text_hash, size, component and its least doc_id, of every document row."""
    scratch = Scratch(docs.sparkSession)
    signed = scratch.write(signatures(docs, width), "near-signatures")
    every = scratch.write(signed.drop("bands", "sketch"), "near-ids")
    filled = every.where("size > 0")
    classes = scratch.write(filled.groupBy("key").agg(F.min("row").alias("rep")), "near-classes")
    roots = roots_of(docs, signed, classes, width, threshold, scratch)
    rooted = classes.join(roots, F.col("rep") == F.col("vertex"), "left").select("key", F.coalesce("root", "rep").alias("component"))
    classed = filled.select("row", "doc_id", "text_hash", "size", "key").join(rooted, "key").drop("key")
    alone = every.where("size = 0").select("row", "doc_id", "text_hash", "size", (-F.col("row") - 1).alias("component"))
    rows = materialize(classed.unionAll(alone), "near-components")
    scratch.drop_all()
    least = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "component").select(*ROWS_OUT)


def near_duplicates(docs: DataFrame, width: int, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document row."""
    rows = near_rows(docs, width, threshold)
    return rows.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def keep_one_each(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``docs`` less the rows that are near duplicates of a kept one: of each component one row stays.

    It is a row with the smallest id; of several with that id the one with the smallest hash of its text; rows without
    an id come last. Rows without words stay. Rows are told apart by id and text, so other rows with the id of a
    duplicate are judged by their own texts.
    """
    rows = near_rows(docs, width, threshold)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    kept = rows.groupBy("component").agg(best.alias("best"))
    judged = rows.where("size > 0").join(kept, "component")
    mine = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    found = judged.groupBy("doc_id", "text_hash").agg(F.max(mine).alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")
    found = materialize(found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("stays").alias("__stays")), "near-decisions")
    maybe, free = may_be_among(docs, found.select("__id"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__hash"))
    told = maybe.join(found, same, "left")
    once = told.where("__stays is null").select(*docs.columns)
    again = told.where("__stays").dropDuplicates(["__id", "__hash"]).select(*docs.columns)
    return free.unionAll(once).unionAll(again)
