"""Language model, licenses, robust outliers and the pipeline."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import gru, licenses, lm, outliers, registry
from docloom.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_words long, score double, row long"
ODD = [(1, None, "en", "s", 0, 0.0, 1), (2, "", None, None, 0, 0.0, 1), (None, "a b", "en", "s", 0, 0.0, 1), (3, "Long words " * 20_000, "en", "s", 0, 0.0, 1), (4, "a B", "en", "s", 0, 0.0, 1), (4, "a B", "en", "s", 0, 0.0, 1)]


def test_gradients():
    g = gru.Gru(seed=1)
    g.p = {k: v.astype(np.float64) * 3 for k, v in g.p.items()}
    tokens = np.random.default_rng(0).integers(0, gru.VOCAB, (3, 9))
    tokens[1, 6:] = -1
    _, grads, *_ = g.loss_and_grads(tokens)
    for name, x in grads.items():
        at = np.unravel_index(np.abs(x).argmax(), x.shape)
        old, two = g.p[name][at], []
        for d in (1e-5, -1e-5):
            g.p[name][at] = old + d
            two.append(g.loss_and_grads(tokens)[0])
        g.p[name][at] = old
        assert (two[0] - two[1]) / 2e-5 == pytest.approx(x[at], rel=1e-4)


def test_state_is_carried_through_the_whole_document():
    g = gru.Gru(seed=2)
    r = np.random.default_rng(1)
    docs = [np.append(r.integers(1, gru.VOCAB, n), gru.END) for n in (0, 1, 63, 64, 65, 300)]
    got = g.score(docs)
    for d, s in zip(docs, got):  # one word at a time
        h, before, total = np.zeros((1, gru.HIDDEN), np.float32), np.array([gru.END]), 0.0
        for w in d:
            h, _ = g.step(h, before)
            total += g.log_probs(h, np.array([w]))[0]
            before = np.array([w])
        assert s == pytest.approx(total, rel=1e-4)
    h = r.normal(size=(2, gru.HIDDEN)).astype(np.float32)
    every = np.exp([g.log_probs(h, np.full(2, w)) for w in range(gru.VOCAB)]).sum(0)
    assert every == pytest.approx([1, 1], rel=1e-4)  # a distribution


def test_lanes_are_filled_and_begin_each_document_anew(monkeypatch):
    """Steps follow the words or the longest document, not the longest of every group; each score is that of the document alone."""
    monkeypatch.setattr(gru, "SCORED", 4)
    monkeypatch.setattr(gru, "EVERY", 7)
    monkeypatch.setattr(gru, "STATES", 50, raising=False)
    g = gru.Gru(seed=6)
    g.p = {k: v * 3 for k, v in g.p.items()}
    r = np.random.default_rng(8)
    docs = [np.append(r.integers(1, gru.VOCAB, n - 1), gru.END) if n else np.zeros(0, np.int64) for n in [40] * 20 + [0, 400] + [40] * 23 + [1, 0]]
    want = []
    for d in docs:
        h, before, total = np.zeros((1, gru.HIDDEN), np.float32), np.array([gru.END]), 0.0
        for w in d:
            h, _ = g.step(h, before)
            total += g.log_probs(h, np.array([w]))[0]
            before = np.array([w])
        want.append(total)
    steps, tanh = [0], np.tanh

    def counted(*args, **named):
        steps[0] += 1
        return tanh(*args, **named)

    monkeypatch.setattr(gru.np, "tanh", counted)
    assert np.allclose(g.score(docs), want, rtol=1e-5)
    assert steps[0] < 1.2 * max(400, sum(map(len, docs)) / 4)
    assert g.score([]).tolist() == [] and g.score(docs[20:21]).tolist() == [0]


@pytest.mark.parametrize("rows", [1, 5, 64])
def test_blocks_of_outputs_add_up(monkeypatch, rows):
    """Classes that lie across blocks, and blocks that hold several classes, give the whole gradient and the same probabilities."""
    g = gru.Gru(seed=9)
    g.p = {k: v.astype(np.float64) * 3 for k, v in g.p.items()}
    r = np.random.default_rng(2)
    tokens = np.where(r.random((6, 17)) < 0.5, r.integers(0, 200, (6, 17)), r.integers(0, gru.VOCAB, (6, 17)))
    tokens[2, 9:] = -1
    h, y = r.normal(size=(90, gru.HIDDEN)), r.integers(0, 300, 90)
    loss, grads, n, last = g.loss_and_grads(tokens)
    probs = g.log_probs(h, y)
    monkeypatch.setattr(gru, "ROWS", rows)
    loss_, grads_, n_, last_ = g.loss_and_grads(tokens)
    assert loss_ == pytest.approx(loss, rel=1e-12) and n_ == n and np.array_equal(last, last_)
    assert all(np.allclose(grads_[k], x, rtol=1e-10, atol=1e-12) for k, x in grads.items())
    assert np.allclose(g.log_probs(h, y), probs, rtol=1e-12)
    every = g.loss_and_grads(np.full((2, 9), -1))
    assert every[0] == 0 and every[2] == 0 and not any(x.any() for x in every[1].values())


def test_parts_scored_together_keep_their_rows(monkeypatch):
    """Texts of several parts and batches go through the recurrent model at once, and each row has its own score."""
    r = np.random.default_rng(12)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(r.choice([*words, "rare", "words"], r.integers(0, 60))) for _ in range(90)] + ["", "w1 " * 500]
    tables = lm.Tables([w.encode() for w in words], np.arange(50, 0, -1), 1400, 53, 80, lm.Spelling(np.array([5]), np.array([3.0])), gru.Gru(seed=1).flat())
    batches = [pa.RecordBatch.from_arrays([pa.array([*range(i, i + len(t))][:-1] + [None]), pa.array(t)], ["doc_id", "text"]) for i in range(0, len(texts), 23) if (t := texts[i : i + 23])]
    score, calls = gru.Gru.score, []
    monkeypatch.setattr(gru.Gru, "score", lambda self, docs: calls.append(len(docs)) or score(self, docs))
    one_each = [pa.Table.from_batches(lm._score_batches(tables)(iter([b.slice(i, 1)]))) for b in batches for i in range(len(b))]
    calls.clear()
    monkeypatch.setattr(lm, "SCORED_BYTES", 700)
    monkeypatch.setattr(lm, "BESIDE_BYTES", 6000, raising=False)
    got = pa.Table.from_batches(lm._score_batches(tables)(iter(batches)))
    want = pa.concat_tables(one_each)
    assert 1 < len(calls) < 5 and sum(calls) == len(texts)
    assert np.allclose(got["score"].to_numpy(), want["score"].to_numpy(), rtol=1e-5)
    flat = lambda t: t.drop_columns("score").to_pylist()
    for x, y in zip(flat(got), flat(want)):
        assert sorted(map(str, x.pop("rare"))) == sorted(map(str, y.pop("rare"))) and x.pop("base") == pytest.approx(y.pop("base")) and x == y


def test_every_word_is_a_target_once_with_its_state(monkeypatch):
    """Without learning, the states that windows begin in are those of reading each document word by word."""
    r = np.random.default_rng(7)
    docs = [np.append(r.integers(1, gru.VOCAB, n), gru.END) for n in (0, 15, 16, 64, 7, 200, 33, 1)]
    g = gru.Gru(seed=4)
    want = []
    for d in docs:
        h, before = np.zeros((1, gru.HIDDEN), np.float32), gru.END
        for i, w in enumerate(d):
            if i % gru.WINDOW == 0:
                want.append(([before, *d[i : i + gru.WINDOW].tolist()], h[0]))
            h, _ = g.step(h, np.array([before]))
            before = w
    got, train = [], gru.Gru.train

    def watched(self, tokens, rate, start):
        got.extend(([x for x in row.tolist() if x >= 0], h) for row, h in zip(tokens, start.copy()))
        return train(self, tokens, 0.0, start)

    monkeypatch.setattr(gru.Gru, "train", watched)
    assert g.train_all(iter(docs), 0.1, 3) == len(want) == len(got)
    for (tokens, h), (tokens_, h_) in zip(sorted(want, key=lambda x: x[0]), sorted(got, key=lambda x: x[0])):
        assert tokens == tokens_ and np.allclose(h, h_, atol=1e-5)


def test_training_lowers_the_loss():
    g = gru.Gru(seed=3)
    seq = np.tile([2, 70, 3, 900], 100)
    before = g.score([seq])[0]
    for _ in range(4):
        g.train_all(iter([seq] * 8), 0.1, 8)
    assert g.score([seq])[0] > before / 2


def test_held_out_texts_beat_the_word_frequencies(spark):
    """Texts whose words follow one another: on words that the model knows, held-out texts are likelier than by counts alone."""
    r = np.random.default_rng(3)
    after = r.integers(0, 60, (60, 2))
    rows = []
    for i in range(1500):
        w, text = int(r.integers(60)), []
        for _ in range(60):
            text.append(f"w{w}")
            w = int(after[w, r.integers(2)]) if r.random() < 0.9 else int(r.integers(60))
        rows.append((i, " ".join(text)))
    got = lm.score_corpus(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).where("held_out").collect()
    assert len(got) > 200 and sum(x["score"] for x in got) > sum(x["base_score"] for x in got) * 0.9


def check_base(docs, got):
    tokens = {d: re.findall(r"[^\x20\x09-\x0D]+", (t or "").encode().lower().decode()) + [None] for d, t in docs}
    counts = Counter(w for d, t in docs for w in tokens[d] if d is not None and zlib.crc32(str(d).encode()) % 5 != 1)
    n, v = sum(counts.values()), len(counts)
    for r in got:
        w = tokens[r["doc_id"]]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and math.isfinite(r["score"]) and r["score"] <= 0
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)


def test_base_score_and_rare_words(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 500)  # most words go through the join
    monkeypatch.setattr(lm, "START_ROUNDS", 1)
    docs = table(spark, sf_dir, "documents")
    check_base([(r["doc_id"], r["text"]) for r in docs.collect()], lm.score_corpus(docs).collect())


def test_lm_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "START_ROUNDS", 1)
    docs = spark.createDataFrame(ODD, DOCS)
    got = lm.score_corpus(docs).collect()
    assert len(got) == len(ODD)
    check_base([r[:2] for r in ODD], got)
    assert all(math.isfinite(r["score"]) for r in got)
    none = lm.score_corpus(docs.where("doc_id is null")).collect()
    assert none[0]["train_tokens"] == 0 and none[0]["base_score"] == 0
    assert lm.score_corpus(docs.where("false")).count() == 0


def test_spelling_is_a_distribution():
    s = lm.Spelling(np.array([5, 300]), np.array([3.0, 4.0]))
    assert np.allclose((10.0 ** s.log.astype(float)).sum(1), 1, atol=1e-5)


def test_long_unknown_words_cost_all_their_letters(spark):
    rows = [(-5.0, 0), (-5.0, 3), (-290.0, 0), (-1000.0, 0), (-3e6, 0), (-1000.0, 3), (-1.0, 1)]
    got = spark.createDataFrame(rows, "spelled double, c long").select(lm.unknown_log10(F.col("spelled"), F.col("c"), 100).alias("x"), "spelled", "c").collect()
    for r in got:
        small = r["spelled"] < -200
        want = math.log10(lm.SPELLED) + r["spelled"] if r["c"] == 0 else math.log10((0 if small else lm.SPELLED * 10 ** r["spelled"]) + (1 - lm.SPELLED) * r["c"] / 100)
        assert r["x"] == pytest.approx(want, rel=1e-12)


def test_longest_word_scores_by_its_length(spark, monkeypatch):
    monkeypatch.setattr(lm, "START_ROUNDS", 1)
    docs = spark.createDataFrame([(i, "some plain words here") for i in range(40)] + [(None, "q" * 1000), (None, "q" * 100_000)], "doc_id long, text string")
    short, long = sorted((r["score"] for r in lm.score_corpus(docs).where("doc_id is null").collect()), reverse=True)
    assert long < 50 * short


def test_averages_in_groups(spark):
    flat = [np.full(4, float(i), np.float32) for i in range(100)]
    df = spark.createDataFrame([(i + 1, bytearray(w.tobytes())) for i, w in enumerate(flat)], "n long, weights binary")
    want = sum((i + 1) * i for i in range(100)) / 5050
    assert np.allclose(lm.averaged(df), want, rtol=1e-5)
    assert lm.averaged(df.where("false")) is None


def test_licenses_equal_sql(spark, sf_dir):
    got = licenses.scan(licenses.document_files(table(spark, sf_dir, "documents")))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    q = c.execute(licenses.oracle())
    cols = [d[0] for d in q.description]
    assert sorted(cols) == sorted(got.columns)
    key = lambda r: str(r)
    assert sorted((tuple(r[x] for x in cols) for r in got.collect()), key=key) == sorted(q.fetchall(), key=key)


def test_nearest_directory(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "LICENSE", mit), (2, "a/x.py", "code"), (3, "a/b/COPYING.txt", gpl), (4, "a/b/c/d.py", "code"), (5, "a/b/own.py", f"# {mit}\ncode"), (6, None, "code"), (7, "a/x.py", None), (8, "top.py", ""), (9, None, gpl), (10, "a/bc/x.py", "text " * 50_000), (11, "z/LICENSE", "no known words")]
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, path string, text string, license string, row long")
    got = {r["doc_id"]: (r["license"], r["found"]) for r in licenses.scan(docs).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("GPL-3.0", "own"), 4: ("GPL-3.0", "inherited"), 5: ("MIT", "own"), 6: (None, "none"), 7: ("MIT", "inherited"), 8: ("MIT", "inherited"), 9: ("GPL-3.0", "own"), 10: ("MIT", "inherited"), 11: ("MIT", "inherited")}
    assert licenses.scan(docs.where("false")).count() == 0


def test_counts_by_brute_force(spark):
    r = np.random.default_rng(4)
    texts = ["".join(r.choice(["a", "b", "c ", " ", "\n", "#", "é", "\t", "| "], r.integers(0, 80))) for _ in range(150)] + ["x " * 40_000]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for row in outliers.counts(df).collect():
        t = texts[row["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_planted_outliers_go_and_others_stay(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(600):
        n = int(r.integers(80, 300))
        words = ["".join(r.choice(list("abcdefghij"), r.integers(3, 8))) for _ in range(n)]
        if i % 20 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en", "hot" if i % 3 else "other"))
    got = outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), least=150).collect()
    bad = [x["doc_id"] for x in got if x["doc_id"] % 20 == 0 and x["kept"]]
    lost = [x["doc_id"] for x in got if x["doc_id"] % 20 and not x["kept"]]
    assert not bad and len(lost) <= 6


def test_distance_equals_numpy(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(400, outliers.P)) @ r.normal(size=(outliers.P, outliers.P)) * 0.3
    df = spark.createDataFrame([("p", 0, *map(float, v)) for v in x], "pool string, start int, " + ", ".join(f"{v} double" for v in outliers.VECTOR))
    got = outliers._with_distance(df.drop("start"), outliers._factored(outliers._moments(df, 1.0)))
    cov = np.cov(x.T, bias=True)
    cov[np.diag_indices(outliers.P)] = np.maximum(np.diag(cov), [f**2 for f in outliers.FLOORS.values()])
    want = np.einsum("ij,jk,ik->i", x - x.mean(0), np.linalg.inv(cov), x - x.mean(0))
    assert np.allclose(sorted(r["d2"] for r in got.collect()), np.sort(want), rtol=1e-6)


def test_outliers_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    got = outliers.judge(docs).collect()
    assert len(got) == len(ODD) and not any(r["kept"] for r in got)  # short, or one phrase over and over
    assert outliers.judge(docs.where("false")).count() == 0
    assert outliers.judge(docs.select("doc_id", "text")).count() == len(ODD)


def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, before, sf_dir), f"test-{name}")
        assert after.columns == docs.columns and 0 < after.count() <= before.count()
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    tokens = {r["doc_id"]: r["doc_tokens"] for r in last.collect()}
    assert set(tokens) == {r["doc_id"] for r in before.select("doc_id").collect()}


def test_registry():
    names = list(registry.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names[:-1]] == list(range(1, 11)) and names[-1] == "pipeline"


def test_estimate_is_the_least_determinant_of_both_starts(spark):
    """Against numpy's concentration steps: a group of its own, with a third of its rows far away and close together."""
    r = np.random.default_rng(11)
    x = np.concatenate([r.normal(size=(200, outliers.P)), 0.2 * r.normal(size=(90, outliers.P)) + 6])
    df = spark.createDataFrame([(i, "p", *map(float, v)) for i, v in enumerate(x)], "doc_id long, pool string, " + ", ".join(f"{v} double" for v in outliers.VECTOR))
    lot = {r_[0] for r_ in df.where(F.pmod(F.xxhash64("doc_id", *outliers.VECTOR), F.lit(2)) == 0).select("doc_id").collect()}
    floors = np.array([f**2 for f in outliers.FLOORS.values()])

    def kept(cov):
        cov = cov.copy()
        cov[np.diag_indices(outliers.P)] = np.maximum(np.diag(cov), floors)
        return cov

    q = np.sort(x, 0)
    at = lambda p, a: a[max(0, int(np.ceil(p * len(a))) - 1)]
    starts = [(at(0.5, q), kept(np.diag(((at(0.75, q) - at(0.25, q)) / 1.349) ** 2)))]
    half = x[sorted(lot)]
    starts.append((half.mean(0), kept(np.cov(half.T, bias=True))))
    found = []
    for m, c in starts:
        for _ in range(outliers.STEPS):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            core = x[d <= at(outliers.CORE, np.sort(d))]
            m, old, c = core.mean(0), c, kept(np.cov(core.T, bias=True) * outliers.CORE / outliers.CHI2_CORE_NEXT)
            if abs(np.linalg.slogdet(old)[1] - np.linalg.slogdet(c)[1]) < 1e-9:
                break
        found.append((np.linalg.slogdet(c)[1], m))
    got = outliers.estimates(df).collect()
    assert len(got) == 1 and [got[0][f"m{i}"] for i in range(outliers.P)] == pytest.approx(list(min(found, key=lambda t: t[0])[1]), abs=1e-3)


def test_small_groups_are_judged_by_larger_pools(spark):
    r = np.random.default_rng(6)
    make = lambda n: " ".join("".join(r.choice(list("abcdefghij"), r.integers(3, 8))) for _ in range(n))
    rows = [(i, make(int(r.integers(80, 300))), "en", "big" if i % 10 else f"small{i}") for i in range(400)]
    rows += [(1000 + i, " ".join(w + "###" for w in make(100).split()), lang, "rare") for i, lang in enumerate(("en", "xx", None))]
    got = {x["doc_id"]: x["kept"] for x in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[1000 + i] for i in range(3)) and np.mean([got[i] for i in range(400)]) > 0.98
