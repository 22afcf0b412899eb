"""Near duplicates and benchmark passages against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from docloom.llm import decontaminate, neardup
from docloom.llm.common import table
from docloom.llm.components import connected_components

DOCS = "doc_id long, text string, row long, size string, key string"


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(rows, width):
    """By all pairs that share a shingle; rows are (id, text)."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    sets = [shingles(t, width) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x])
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(i)
    return {d: find(d) for d, _ in rows}, {d: len(s) for (d, _), s in zip(rows, sets)}


def test_components_of_random_edges(spark):
    r = random.Random(1)
    for n, m in ((30, 20), (60, 80), (50, 49)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(n - 1)] if m == 49 else [])
        root = list(range(n))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        got = {x["vertex"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert {i: got.get(i, i) for i in range(n)} == {i: find(i) for i in range(n)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_whole_table(spark, sf_dir, width):
    docs = table(spark, sf_dir, "documents")
    want, sizes = components([(r["doc_id"], r["text"]) for r in docs.collect()], width)
    got = neardup.near_duplicates(docs, width).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_chain_of_copies(spark):
    """Each text changes a few words of the one before: only the ends' neighbours are linked, yet all are one component."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        for _ in range(5):
            words[r.randrange(300)] = f"n{i}_{r.random()}"
        rows.append((100 + i, " ".join(words)))
    want, _ = components(rows, 2)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == want


def test_group_around_one_text(spark):
    r = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        w = list(base)
        for _ in range(r.choice([3, 8, 12, 16])):
            w[r.randrange(200)] = f"x{i}_{r.random()}"
        rows.append((i, " ".join(w)))
    want, _ = components(rows, 2)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == want


def test_odd_rows(spark):
    rows = [(4, None, 1, "a", "b"), (5, "", 1, "a", "b"), (6, " \n", 1, "a", "b"), (9, "One two", 1, "a", "b"), (8, "one TWO", 1, "a", "b"), (8, "one TWO", 1, "a", "b"), (7, "one", 1, "a", "b"), (None, "one two", 1, "a", "b"), (3, "word " * 50_000, 1, "a", "b")]
    docs = spark.createDataFrame(rows, DOCS)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, 2).collect()]
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted([(4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (9, 1, 8, False), (8, 1, 8, True), (8, 1, 8, True), (7, 1, 7, True), (None, 1, 8, False), (3, 1, 3, True)], key=key)
    kept = neardup.keep_one_each(docs, 2)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 7, 8]
    assert neardup.near_duplicates(docs.where("false"), 2).count() == 0


def test_bands_estimate():
    a, b = neardup.universal()
    x = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1200, np.uint64))
    one, two = x[:1000], x[100:1100]
    est = (neardup.minima(one, a, b) == neardup.minima(two, a, b)).mean()
    assert abs(est - 900 / 1100) < 0.1


def edits(words, count, r, vocab):
    w = list(words)
    for _ in range(count):
        k, p = r.randrange(3), r.randrange(len(w))
        if k == 0:
            w[p] = r.choice(vocab)
        elif k == 1:
            del w[p]
        else:
            w.insert(p, r.choice(vocab))
    return w


def least_distance(item, text):
    """Sellers' table, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_recall_and_precision_of_items():
    r = random.Random(5)
    vocab = [f"v{i}" for i in range(400)]
    bench = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(6, 60)))) for i in range(60)]
    items = decontaminate.Items(bench)
    texts = []
    for _ in range(150):
        i, t = r.choice(bench)
        w = t.split()
        host = [r.choice(vocab) for _ in range(120)]
        p = r.randrange(120)
        texts.append(" ".join(host[:p] + edits(w, r.randint(0, len(w) // 4), r, vocab) + host[p:]))
    found = decontaminate.find_in_texts(items, texts)
    hit = total = 0
    for t, f in zip(texts, found):
        w = t.split()
        true = {i: d for i, x in bench if (d := least_distance(x.split(), w)) <= len(x.split()) // 5}
        got = {i: d for i, d, _, _ in f}
        assert got.items() <= true.items()  # exact distances, nothing else
        hit += len(got)
        total += len(true)
        for _, d, s, n in f:
            assert 0 <= s and s + n <= len(w)
    assert hit / total >= 0.97


@pytest.mark.parametrize("n", [15, 25, 60, 100, 200, 300])
@pytest.mark.parametrize("kind", ["substitute", "delete", "insert"])
def test_recall_at_the_limit(n, kind):
    """At exactly a fifth of edits, whatever the item's size."""
    r = random.Random(n)
    vocab = [f"v{i}" for i in range(2000)]
    some = lambda k: [r.choice(vocab) for _ in range(k)]
    bench = [(i, some(n)) for i in range(max(30, 3000 // n))]
    texts = []
    for _, words in bench:
        w = list(words)
        for p in sorted(r.sample(range(n), n // 5), reverse=True):
            w[p : p + (kind != "insert")] = [] if kind == "delete" else some(1)
        texts.append(" ".join(some(30) + w + some(30)))
    found = decontaminate.find_in_texts(decontaminate.Items([(i, " ".join(w)) for i, w in bench]), texts)
    assert sum(i in {f[0] for f in x} for (i, _), x in zip(bench, found)) >= 0.97 * len(bench)


def test_items_odd_rows(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", 1), (2, None, 1), (3, "", 1), (None, "alpha beta", 1), (4, "lone", 1)], "item_id long, text string, doc_id long")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x ALPHA beta gamma delta epsilon zeta eta theta iota kappa y"), (4, "alpha beta gamma delta other zeta eta iota kappa"), (5, "a lone word"), (6, "word " * 100_000), (6, "a lone word")], "doc_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.find_items(docs, bench).collect())
    assert got == [(3, 1, 0, 1, 10), (4, 1, 2, 0, 9), (5, 4, 0, 1, 1), (6, 4, 0, 1, 1)]
    assert got == sorted(tuple(r) for r in decontaminate.find_items(docs, bench, block=1).collect())
    assert decontaminate.find_items(docs, bench.where("false")).count() == 0 and decontaminate.find_items(docs.where("false"), bench).count() == 0
    assert sorted(r[0] for r in decontaminate.drop_contaminated(docs, bench).collect()) == [1, 2, 6]


def test_items_whole_table(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    items = bench.collect()
    squeeze = lambda t: " ".join(t.lower().split())
    exact = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items if f" {squeeze(i['text'])} " in f" {squeeze(d['text'])} "}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_items(docs, bench).collect()}
    assert exact and exact <= got
