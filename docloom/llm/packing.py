"""Packing along a space-filling curve: neighbouring documents share training sequences.

Each document's ids are hashed into a vector, projected by fixed signs to ``DIMS`` numbers, and the numbers' place on a
Hilbert curve is the document's key. All documents are range-sorted by (key, doc_id, row), laid end to end in that
order, and cut every ``SIZE`` tokens: neighbours on the curve stand side by side, and no token of padding is needed
but in the last sequence.

Only keys and lengths are sorted; the ids stay in a table of the shared folder until each document's place is known
and are moved once. Copies share a key, so the row number in the sort order keeps ranges even when a third of all rows
are one text.

Defined results: a null text counts as empty and yields its end id alone; rows with the same id are packed each;
an empty table gives no rows. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import docs_only, materialize

SIZE = 2048
VOCABULARY, END_ID = "byte_bpe_50k.json", 1
BUCKETS, DIMS, BITS = 1024, 4, 12
_MIX = np.uint32(2654435761)


def _signs() -> np.ndarray:
    return np.random.default_rng(7).choice([-1.0, 1.0], (BUCKETS, DIMS))


def hashed_vectors(ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Of each document of ``ids`` (from edge to edge) the square roots of the counts of hashed ids, of length 1."""
    n = len(edges) - 1
    cell = ((ids.astype(np.uint32) * _MIX) >> np.uint32(22)).astype(np.int64) + np.repeat(np.arange(n) * BUCKETS, np.diff(edges))
    counts = np.bincount(cell, minlength=n * BUCKETS).reshape(n, BUCKETS)
    return np.sqrt(counts) / np.sqrt(np.maximum(1, counts.sum(1, keepdims=True)))


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, dims), by Skilling's transposition, all points at once."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[dims - 1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray, signs: np.ndarray) -> np.ndarray:
    flat = np.tanh(vectors @ signs)
    cells = np.clip(((flat + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert_keys(cells)


def binaries(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The values from edge to edge as a column of bytes."""
    raw = (edges * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(raw.tobytes()), pa.py_buffer(values.tobytes())])


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """doc_id, row, curve key, number of ids, and the ids as little-endian integers."""
    signs = _signs()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from docloom.llm.tokens import encoder

        code = encoder(vocabulary)
        for b in it:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids, edges = code.encode_column(part.column(1), end_id)
                vectors = hashed_vectors(ids, edges)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(curve_keys(vectors, signs)), pa.array(np.diff(edges)), binaries(ids, edges)], ["doc_id", "key", "n", "ids"])

    return docs_only(docs).mapInArrow(batches, "doc_id long, key long, n long, ids binary").withColumn("row", F.monotonically_increasing_id())


def places(tokens: DataFrame) -> DataFrame:
    """row and the position of its first id in the curve's order: sums in each range, then over the ranges."""
    order = ["key", "doc_id", "row"]
    ranged = tokens.select("row", "key", "doc_id", "n").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "pack-order")
    sums = ranged.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(bases), F.col("part") == F.col("p")).select("row", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("place"))


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str = VOCABULARY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Pieces with their ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian, 2 or 4 bytes each).

    The checksum is that of the ids as unsigned 32-bit integers; without ``keep_ids`` there is no column of ids.
    """
    tokens = materialize(encoded(docs, vocabulary, end_id), "pack-ids")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[list] = [[] for _ in range(8)]
            for doc, n, place, found in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                ids = found.as_buffer()  # of the batch's own memory
                width, at = len(ids) // n, 0
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
                while at < n:
                    length = min(size - (place + at) % size, n - at)
                    crc = zlib.crc32(wide[at : at + length].tobytes())
                    piece = ids[at * width : (at + length) * width].to_pybytes() if keep_ids else b""
                    for k, v in enumerate((doc, at, length, crc, n, (place + at) // size, (place + at) % size, piece)):
                        out[k].append(v)
                    at += length
            cols = [pa.array(x, pa.binary() if k == 7 else pa.int64()) for k, x in enumerate(out)]
            yield pa.RecordBatch.from_arrays(cols[: len(names)], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    placed = tokens.join(places(tokens), "row").select("doc_id", "n", "place", "ids")
    return placed.mapInArrow(cut, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names))


def digest(docs: DataFrame) -> DataFrame:
    """The pieces of the packed documents, without their ids."""
    return pack(docs, keep_ids=False)
