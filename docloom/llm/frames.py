"""Token ids in seekable binary shards: independent zstandard frames with a trailing seek table.

A shard holds, one after the other: data frames (each a zstandard frame of its own, with a content checksum, of the
ids of whole documents, up to about ``FRAME_BYTES`` unless one document is larger); a skippable frame with the document
index (ids and token counts, compressed); a skippable frame with the seek table: per data frame its compressed size,
decompressed size and crc32 of the decompressed bytes, then the index frame's place, the width of an id and a magic number. Other
zstandard readers skip both tables. A reader takes the tables from the shard's end and decompresses only the frames
that hold the documents asked for.

Documents are range-partitioned and sorted by id, those of one id by a hash of their text; a task writes one shard under a name of its attempt and renames it,
so a repeated task replaces what a lost one left. Shards are numbered in the order of ids.

Defined results: a null text counts as empty and yields its end id alone; rows without an id come first; rows with the
same id are ordered by a hash of their text; an empty table makes no shard with documents and no rows. Columns other than doc_id and
text are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import docs_only, new_dir

FRAME_BYTES = 1 << 18
LEVEL = 3
VOCABULARY, END_ID = "word_bpe_49k.json", 2
INDEX_MAGIC, TABLE_MAGIC, FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x4C544F4B
NO_ID = -(1 << 63)
_FOOT = struct.Struct("<QIII")  # offset of the index frame, frames, width, magic


def filesystem(uri: str):
    """The store of a URI, as every executor reaches it, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class ShardWriter:
    """Appends documents to an open binary stream."""

    def __init__(self, out, width: int, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self.out, self.width, self.most = out, width, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.held: list[bytes] = []
        self.held_bytes = self.at = self.tokens = 0
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.counts: list[int] = []
        self.frame_of: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.held_bytes + len(ids) > self.most:
            self._flush()
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.counts.append(len(ids) // self.width)
        self.frame_of.append(len(self.table))
        self.tokens += len(ids) // self.width
        self.held.append(ids)
        self.held_bytes += len(ids)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            frame = self.packer.compress(raw)
            self.table.append((len(frame), len(raw), zlib.crc32(raw)))
            self._write(frame)
            self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self._flush()
        where = self.at
        body = self.packer.compress(np.array(self.ids, "<i8").tobytes() + np.array(self.counts, "<u4").tobytes() + np.array(self.frame_of, "<u4").tobytes())
        body = struct.pack("<Q", len(self.ids)) + body
        self._write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        body = np.array(self.table, "<u4").tobytes() + _FOOT.pack(where, len(self.table), self.width, FOOT_MAGIC)
        self._write(struct.pack("<II", TABLE_MAGIC, len(body)) + body)


class ShardReader:
    """Random access to an open binary file: ``document(i)`` decompresses the one frame that holds it."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.unpacker = file, zstandard.ZstdDecompressor()
        where, frames, self.width, magic = _FOOT.unpack(self._at(size - _FOOT.size, _FOOT.size))
        if magic != FOOT_MAGIC:
            raise ValueError("not a token shard: its seek table is missing")
        table = np.frombuffer(self._at(size - _FOOT.size - 12 * frames, 12 * frames), "<u4").reshape(-1, 3)
        self.table, self.offsets = table, np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        kind, length = struct.unpack("<II", self._at(where, 8))
        if kind != INDEX_MAGIC:
            raise ValueError("not a token shard: its document index is missing")
        body = self._at(where + 8, length)
        n = struct.unpack_from("<Q", body)[0]
        raw = self.unpacker.decompress(body[8:], max_output_size=16 * n + 1)
        self.ids, self.counts, self.frame_of = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u4", n, 8 * n), np.frombuffer(raw, "<u4", n, 12 * n)
        ends = np.cumsum(self.counts, dtype=np.int64)
        self.starts = ends - self.counts
        first = np.searchsorted(self.frame_of, np.arange(frames))  # each frame's first document
        self.frame_start = self.starts[first] if n else self.starts
        self._held: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        if self._held[0] != k:
            raw = self.unpacker.decompress(self._at(int(self.offsets[k]), int(self.table[k, 0])), max_output_size=int(self.table[k, 1]) + 1)
            if zlib.crc32(raw) != int(self.table[k, 2]) or len(raw) != int(self.table[k, 1]):
                raise ValueError(f"frame {k} fails its checksum")
            self._held = (k, raw)
        return self._held[1]

    def document(self, i: int) -> np.ndarray:
        k = int(self.frame_of[i])
        at = int(self.starts[i] - self.frame_start[k])
        return np.frombuffer(self.frame(k), f"<u{self.width}", int(self.counts[i]), at * self.width)

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of a document, or None where the shard lacks it."""
        i = int(np.searchsorted(self.ids, doc_id))
        return self.document(i) if i < len(self.ids) and self.ids[i] == doc_id else None


def open_shard(uri: str) -> ShardReader:
    store, path = filesystem(uri)
    return ShardReader(store.open_input_file(path), store.get_file_info(path).size)


def write_shards(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> list[tuple[str, int, int]]:
    """Writes the shards and returns (name, documents, tokens) of each, in the order of ids."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from docloom.llm.tokens import encoder

        context = TaskContext.get()
        name = f"shard-{context.partitionId():06d}.tok"
        store, path = filesystem(f"{folder}/{name}")
        store.create_dir(path.rpartition("/")[0], recursive=True)
        own = f"{path}.attempt-{context.taskAttemptId()}"
        code = encoder(vocabulary)
        with store.open_output_stream(own) as out:
            writer = ShardWriter(out, code.kind.itemsize)
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    part = b.slice(at, 512)
                    ids, edges = code.encode_column(part.column(1), end_id)
                    for i, doc in enumerate(part.column(0).to_pylist()):
                        writer.add(doc, ids[edges[i] : edges[i + 1]].tobytes())
            writer.close()
        store.move(own, path)
        row = [[context.partitionId()], [name], [len(writer.ids)], [writer.tokens]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["part", "name", "docs", "tokens"])

    order = ["doc_id", "text_hash", "row"]  # so that ranges hold even where many rows have one id, or are the same
    keyed = docs_only(docs).withColumn("text_hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = ordered.mapInArrow(shard, "part long, name string, docs long, tokens long").collect()  # a row a shard
    return [(r["name"], r["docs"], r["tokens"]) for r in sorted(found, key=lambda r: r["part"]) if r["docs"]]


SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_shards(spark: SparkSession, folder: str, shards: list[tuple[str, int, int]]) -> DataFrame:
    """A row per document, from the files: where its ids start over all shards, how many, and their checksum."""
    names = [n for n, _, _ in shards]
    bases = np.concatenate([[0], np.cumsum([t for _, _, t in shards], dtype=np.int64)]).tolist()
    if not names:
        return spark.createDataFrame([], SCHEMA)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                reader = open_shard(f"{folder}/{names[k]}")
                n = len(reader.ids)
                crc = [zlib.crc32(reader.document(i).astype("<u4").tobytes()) for i in range(n)]
                ids = pa.array(reader.ids, pa.int64(), mask=reader.ids == NO_ID)
                yield pa.RecordBatch.from_arrays([ids, pa.array(reader.starts + bases[k]), pa.array(reader.counts.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(names), 1, len(names)).mapInArrow(rows, SCHEMA)


def write_and_read(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes all documents to a new folder of shards and returns what the files hold."""
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "token-shards")
    return read_shards(spark, folder, write_shards(docs, folder))
