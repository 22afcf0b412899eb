"""J6 against the greedy definition, and on a page of many blocks."""

import random
import time
from collections import Counter

from docloom.operators import spatial


def greedy(texts, blocks, least=0.4):
    size = lambda s: len(s.encode("utf-16-le")) // 2
    free, out = dict(blocks), []
    for n, t in texts:
        best, score = None, 0.0
        for b in sorted(free):
            longest = max(size(t), size(free[b]))
            s = sum((Counter(t) & Counter(free[b])).values()) / longest if longest else 0.0
            if s > score:
                best, score = b, s
        if best is not None and score >= least:
            out.append((n, best, score, free.pop(best) == t))
    return out


def rows(spark, pages):
    return spark.createDataFrame([(p, n, t) for p, some in pages.items() for n, t in some], "page long, n long, text string")


def test_pages_equal_the_greedy_definition(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcde \U0001f600가나") for _ in range(r.randint(0, 9)))
    texts = {p: [(n, word()) for n in range(r.randint(0, 8))] for p in range(60)}
    blocks = {p: [(n, r.choice([word(), *(t for _, t in texts[p])])) for n in range(r.randint(0, 8))] for p in range(60)}
    got = spatial.match_texts(rows(spark, texts), rows(spark, blocks)).collect()
    assert sorted(tuple(x) for x in got) == sorted((p, *m) for p in texts for m in greedy(texts[p], blocks[p]))


def test_one_page_of_ten_thousand_blocks(spark):
    b = spark.range(10_000).selectExpr("1L page", "id n", "concat('block ', md5(cast(id as string)), ' ', id) text")
    t = spark.range(1_000).selectExpr("1L page", "id n", "concat('block ', md5(cast(id * 7 as string)), ' ', id * 7) text")
    began = time.time()
    got = spatial.match_texts(t, b).where("same and block = n * 7").count()
    assert got == 1_000 and time.time() - began < 60
