"""Encoders against the library, exact round trips of shards, packing."""

import io
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import frames, packing
from docloom.llm.common import table
from docloom.llm.tokens import encoder

DOCS = "doc_id long, text string, ids long, key string, row long"
ODD = [(5, None, 1, "x", 1), (2, "", 1, "x", 1), (None, "no id", 1, "x", 1), (7, "same text", 1, "x", 1), (7, "same text", 1, "x", 1), (9, "long words " * 20_000, 1, "x", 1)]
BITS = st.lists(st.sampled_from(["a", "Word", " ", "  ", "\n", "\t", "é", "ß", "İ", "Σ", "ſ", "日", "12", ".", ",", "'s", "\x1c", "\x85", "\xa0", "　", "́", "<|endoftext|>", "#"]), max_size=25)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=300, deadline=None)
@given(bits=BITS)
def test_encoders_equal_the_library(name, bits):
    e, text = encoder(name), "".join(bits)
    want = e.whole.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(e.encode(text), e.kind).tolist() == want


def test_shard_in_memory():
    docs = [(None, b""), (1, b"ab" * 10), (4, b"cd" * 300_000), (9, b"ef")]
    out = io.BytesIO()
    w = frames.ShardWriter(out, 2, frame_bytes=64)
    for i, ids in docs:
        w.add(i, ids)
    w.close()
    data = out.getvalue()
    r = frames.ShardReader(io.BytesIO(data), len(data))
    assert r.ids.tolist() == [frames.NO_ID, 1, 4, 9] and [r.document(i).tobytes() for i in range(4)] == [d for _, d in docs]
    assert r.find(4).tobytes() == docs[2][1] and r.find(3) is None
    # the frames are ordinary and independent: any reader skips the tables
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole == b"".join(d for _, d in docs)
    bad = bytearray(data)
    bad[int(r.offsets[1]) + 12] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        frames.ShardReader(io.BytesIO(bytes(bad)), len(bad)).document(2)
    with pytest.raises(ValueError):
        frames.ShardReader(io.BytesIO(data[:-1]), len(data) - 1)


def test_empty_shard():
    out = io.BytesIO()
    frames.ShardWriter(out, 2).close()
    r = frames.ShardReader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert len(r.ids) == 0 and r.find(1) is None


def test_reader_takes_only_the_frame(spark, tmp_path):
    out = io.BytesIO()
    w = frames.ShardWriter(out, 2, frame_bytes=1 << 10)
    for i in range(200):
        w.add(i, np.full(300, i, "<u2").tobytes())
    w.close()

    class Counting(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            x = super().read(n)
            self.read_bytes += len(x)
            return x

    f = Counting(out.getvalue())
    r = frames.ShardReader(f, len(out.getvalue()))
    before = f.read_bytes
    assert set(r.find(150).tolist()) == {150} and f.read_bytes - before < 200


def expected_ids(text, name, end):
    return np.array(encoder(name).whole.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_round_trip_of_the_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = {r["doc_id"]: r for r in frames.write_and_read(docs).collect()}
    at = 0
    for r in docs.orderBy("doc_id").collect():
        ids = expected_ids(r["text"], frames.VOCABULARY, frames.END_ID)
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == docs.count()


def test_frames_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    got = sorted(frames.write_and_read(docs).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 2, 5, 7, 7, 9]
    assert [r["n_tokens"] for r in got][1:3] == [1, 1]
    assert frames.write_and_read(docs.where("false")).count() == 0


def check_packing(docs, pieces, size=packing.SIZE):
    by_doc = {}
    for r in docs:
        by_doc.setdefault(r["doc_id"], []).append(expected_ids(r["text"], packing.VOCABULARY, packing.END_ID))
    at, seen = 0, {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["sequence_id"] * size + p["offset"] == at and p["length"] > 0 and p["offset"] + p["length"] <= size
        at += p["length"]
        assert any(len(x) == p["doc_tokens"] and zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for x in by_doc[p["doc_id"]])
        seen[p["doc_id"]] = seen.get(p["doc_id"], 0) + p["length"]
    assert seen == {d: sum(map(len, x)) for d, x in by_doc.items()}


def test_packing_covers_each_id_once(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    check_packing(docs.collect(), packing.digest(docs).collect())


def test_packing_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    check_packing(docs.collect(), packing.digest(docs).collect())
    assert packing.pack(docs.where("false")).count() == 0


def test_hilbert_steps_are_unit_steps():
    """Cells in the order of their keys are neighbours, and keys are the cells' own: what makes the curve one."""
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(side**dims))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1)
        assert (steps == 1).all()


def test_neighbours_are_alike(spark):
    rows = [(i, ("alpha beta gamma " if i % 2 else "eins zwei drei ") * (20 + i % 7)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = sorted((r for r in packing.pack(docs).collect() if r["start"] == 0), key=lambda r: (r["sequence_id"], r["offset"]))
    kinds = [r["doc_id"] % 2 for r in pieces]
    assert sum(a != b for a, b in zip(kinds, kinds[1:])) < 20
