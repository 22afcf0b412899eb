"""Hard negatives against a search over all pairs."""

import math
import random

import numpy as np
import pytest

from docloom.llm import negatives as N
from docloom.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int"


def by_all_pairs(rows):
    taking = []
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        taking.append((i, math.fmod(label + 1, 10) if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in e]))
    anchors = {(i, label, tuple(v)) for i, label, v in taking if i % 100 == 0}
    out = []
    for i, label, v in anchors:
        scored = [(-sum(p * q for p, q in zip(v, w)), j, other) for j, other, w in taking if len(w) == len(v)]
        positives = sorted((s, j) for s, j, other in scored if other == label and j != i)[:5]
        for p, j in positives:
            fit = sorted((s, n) for s, n, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p)[:10]
            out += [(i, j, r, n, -p, -s) for r, (s, n) in enumerate(fit, 1)]
    return sorted(out)


def check(df):
    got = sorted(tuple(r) for r in N.mine(N.prepared(df)).collect())
    expected = by_all_pairs([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])
    assert got == expected
    return got


def test_whole_table(spark, sf_dir):
    assert check(table(spark, sf_dir, "embeddings"))


def test_ties_copies_and_small_digits(spark, monkeypatch):
    monkeypatch.setattr(N, "LEFT", 3)
    monkeypatch.setattr(N, "DIGIT", 4)
    monkeypatch.setattr(N, "BLOCK", 4)
    r = random.Random(3)
    rows = [(100 * r.randint(0, 5) if r.random() < 0.03 else 3 * r.randint(0, 130) + 1, [r.choice([0.5, 0.25, 1.0]) for _ in range(3)], r.randint(0, 2), 0, 0) for _ in range(300)]
    rows += [(77, [0.5, 0.5, 0.5], 2, 0, 0)] * 60 + [(k, [0.5, 0.25, 0.5], 1, 0, 0) for k in range(501, 560)]
    assert check(spark.createDataFrame(rows, SCHEMA))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0], 1, 0, 0), (100, None, 1, 0, 0), (200, [1.0, None], 1, 0, 0), (300, [nan, 1.0], 1, 0, 0), (400, [inf, 1.0], 1, 0, 0), (500, [1.0, 1.0], None, 0, 0), (600, [], 1, 0, 0), (601, [], 1, 0, 0), (602, [], 2, 0, 0)]
    rows += [(700, [1.0, 0.5], 3, 0, 0), (701, [0.9, 0.5], 3, 0, 0), (702, [0.5, 0.5], 4, 0, 0), (703, [0.5], 4, 0, 0), (-800, [-1.0, 0.5], 3, 0, 0), (100 * 10**12, [2.0, 0.1], 3, 0, 0)]
    assert check(spark.createDataFrame(rows, SCHEMA))
    assert N.mine(N.prepared(spark.createDataFrame([], SCHEMA))).count() == 0
    assert N.mine(N.prepared(spark.createDataFrame([(1, [1.0], 1, 0, 0)], SCHEMA))).count() == 0


def test_large_components_stay_exact():
    a, b = np.array([[float(1 << 40), 3.0], [1.0, 2.0]]), np.array([[float(1 << 21), 1.0], [5.0, 7.0]])
    assert N.products(a, b).tolist() == [[(1 << 61) + 3, (5 << 40) + 21], [(1 << 21) + 2, 19]]
    assert N.products(np.array([[1e40]]), np.array([[1e30]])).tolist() == [[N.MOST]]


@pytest.mark.parametrize("size", [0, 3])
def test_vectors_of_one_length(size):
    import pyarrow as pa

    column = pa.array([[1.0, 2.0, 3.0], [], [4.0, 5.0, 6.0], [7.0]])
    mine, v = N.vectors(column, size)
    assert v.shape == (len(mine), size) and mine.tolist() == ([1] if size == 0 else [0, 2])
