"""Kneser-Ney languages: shares against a plain computation, held-out accuracy, odd rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from docloom.llm import languages as L
from docloom.llm.common import Scratch, fold_of, table

SCHEMA = "doc_id long, text string, lang string, source string, score double, h long, k int, fold int"


def reduced(text):
    out = " " * (L.ORDER - 1) + "".join(c if L._kept_chars()[ord(c)] else " " for c in text.lower())
    while "  " in out[L.ORDER - 1 :]:
        out = out[: L.ORDER - 1] + out[L.ORDER - 1 :].replace("  ", " ")
    return out if out.endswith(" ") and len(out) > L.ORDER - 1 else out + " "


def plain_model(texts, chars):
    """P(c | context) by the definition, from dictionaries."""
    seen = [Counter() for _ in range(L.ORDER + 1)]
    for t in map(reduced, texts):
        for i in range(L.ORDER - 1, len(t)):
            for k in range(1, L.ORDER + 1):
                seen[k][t[i - k + 1 : i + 1]] += 1
    c = [Counter() for _ in range(L.ORDER + 1)]
    c[L.ORDER] = seen[L.ORDER]
    for k in range(1, L.ORDER):
        for g in seen[k + 1]:
            c[k][g[1:]] += 1
    d, total, kinds = {}, defaultdict(int), defaultdict(int)
    for k in range(1, L.ORDER + 1):
        n = Counter(c[k].values())
        d[k] = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        for g, x in c[k].items():
            total[g[:-1]] += x if len(g) == k else 0
            kinds[g[:-1]] += 1

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / chars
        ctx = g[:-1]
        lower = p(g[1:])
        if not total[ctx]:
            return lower
        return max(c[k][g] - d[k], 0) / total[ctx] + d[k] * kinds[ctx] / total[ctx] * lower

    return p


def test_entropies_equal_the_definition(spark):
    texts = {"aa": ["the cat sat on the mat, the cat!", "a thin cat in the hat"], "bb": ["der hund und die katze", "die katze ist dünn"]}
    rows = [(lang, t) for lang, some in texts.items() for t in some]
    scratch = Scratch(spark)
    m = L.fit(L.counts(spark.createDataFrame(rows, "lang string, text string"), scratch))
    scratch.drop_all()
    chars = len({c for some in texts.values() for t in some for c in reduced(t)}) + 1
    asked = ["the hat", "katze und cat", "Ünique  17 words!?", "x", "", "12"]
    e, sizes = m.entropies(asked)
    for n, lang in enumerate(m.langs):
        p = plain_model(texts[lang], chars)
        for i, t in enumerate(asked[:4]):
            r = reduced(t)
            grams = [r[j - L.ORDER + 1 : j + 1] for j in range(L.ORDER - 1, len(r))]
            assert sizes[i] == len(grams)
            assert e[i, n] == pytest.approx(-sum(math.log2(p(g)) for g in grams) / len(grams), rel=1e-9)
    assert np.isnan(e[4:]).all()


def test_shares_sum_to_one(spark):
    scratch = Scratch(spark)
    m = L.fit(L.counts(spark.createDataFrame([("a", "abra cadabra abracadabra")], "lang string, text string"), scratch))
    scratch.drop_all()
    chars = sorted(set(reduced("abra cadabra abracadabra"))) + ["z"]
    for context in ("abra", "cada", "zzzz", "  ab"):
        x = np.array([ord(c) for ch in chars for c in context + ch], np.uint32)
        at = np.arange(len(chars)) * 5 + 4
        assert 2.0 ** m.log_shares(x, at)[0] @ np.ones(len(at)) == pytest.approx(1.0)


def test_held_out_languages(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r["doc_id"]: r for r in L.identify(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if fold_of(i) == 0]
    assert len(got) == len(truth) and all(got[i]["held_out"] for i in held)
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.99
    assert np.mean([got[i]["accepted"] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_strange_texts_are_rejected(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-5, "qxzv wkjq zzxq vvkq jjxw qqzx wxyv kqjz xvqw zkjx", None), (-6, "Съешь же ещё этих мягких французских булок, да выпей чаю", None)], "doc_id long, text string, lang string")
    got = L.identify(docs.union(odd)).where("doc_id < 0").collect()
    assert len(got) == 2 and not any(r["accepted"] for r in got)


def test_odd_rows(spark):
    rows = [(1, None, "en", "s", 0.0, 0, 0, 0), (2, "", "en", "s", 0.0, 0, 0, 0), (3, "12 34 %", "en", None, 0.0, 0, 0, 0), (None, "words here", "en", "s", None, None, None, None), (4, "lost words", None, "s", 0.0, 0, 0, 0), (5, "mots perdus ici", "fr", "s", 0.0, 0, 0, 0)]
    rows += [(6, "word " * 300_000, "en", "s", 0.0, 0, 0, 0)] * 2 + [(k, f"some english words number {k}", "en", "s", 0.0, 0, 0, 0) for k in range(7, 40)] + [(k, "quelques mots", "", "s", 0.0, 0, 0, 0) for k in range(40, 60)]
    got = L.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and all(by[k]["score"] == 0 for k in (1, 2, 3))
    assert by[4]["lang_pred"] == "en" and by[41]["lang_pred"] == "" and not by[None]["held_out"]
    assert L.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = L.identify(spark.createDataFrame([(1, "some words", None, "s", 0.0, 0, 0, 0)], SCHEMA)).collect()
    assert [(r["lang_pred"], r["score"], r["accepted"]) for r in alone] == [("und", 0.0, False)]


def test_samples_keep_whole_texts_within_bounds(spark):
    rows = [(k % 7, "x" if k % 3 else "y", f"text {k % 50} " * 5) for k in range(600)]
    docs = L.teaching(spark.createDataFrame([(k, t, lang) for k, (_, lang, t) in enumerate(rows)], "doc_id long, text string, lang string"))
    got = L.sampled(docs, 10, 10_000).collect()
    assert len(got) == 20 and len(set(got)) == 20 and {r["text"] for r in got} <= {t for _, _, t in rows}
    assert len(L.sampled(docs, 10, 1).collect()) == 2
