"""Joins by place on the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as G

RECT = ("x0", "y0", "x1", "y1")


def rect(prefix: str = "") -> Column:
    return F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in RECT))


def inside_any(inner: DataFrame, outer: DataFrame, keys: list[str], least: float = 0.8) -> DataFrame:
    """Rows of ``inner`` of whose area ``least`` lies in one row of ``outer`` on the same page."""
    o = outer.select(*keys, *(F.col(c).alias(f"o_{c}") for c in RECT))
    hit = inner.join(o, keys).where(G.containment(rect(), rect("o_")) >= least)
    return hit.drop(*(f"o_{c}" for c in RECT)).distinct()


def nearest(captions: DataFrame, media: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` nearest media of each caption on its page, by centre; ties by number."""
    m = media.select("page", F.col("n").alias("media_n"), *(F.col(c).alias(f"o_{c}") for c in RECT))
    pairs = captions.join(m, "page").withColumn("distance", G.centre_distance(rect(), rect("o_")))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("page", "n").orderBy("distance", "media_n")))
    return ranked.where(F.col("rank") <= k).select("page", "n", "media_n", "distance", "rank")


def visual_order(boxes: DataFrame) -> DataFrame:
    """By top, then left, then number."""
    return boxes.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0", "n")))


def greedy_captions(pairs: DataFrame, most: float = 0.35) -> DataFrame:
    """Each target takes its best caption that none before it took; targets in order, a page at a time.

    The choice depends on those before it, so a page's few pairs are folded in Python.
    """
    import pandas as pd

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for target, g in p.sort_values(["target", "score", "caption"], ascending=[True, False, True]).groupby("target", sort=True):
            free = g[(g.distance < most) & ~g.caption.isin(used)]
            if len(free):
                best = free.iloc[0]
                used.add(best.caption)
                out.append((best.page, target, best.caption, best.score))
        return pd.DataFrame(out, columns=["page", "target", "caption", "score"])

    return pairs.groupBy("page").applyInPandas(fold, "page long, target long, caption long, score double")


def match_texts(found: DataFrame, blocks: DataFrame, least: float = 0.4) -> DataFrame:
    """Read texts (page, n, text) matched one to one, in order, with the best free block of the text layer.

    An equal block is used up without a row; J7's leftovers are the blocks of no row here. The order decides, so a page is one
    fold; of its blocks it holds the characters' counts by column, and each text is compared with all free blocks at once over its
    own characters: ten thousand blocks take seconds and some tens of megabytes.
    """
    import numpy as np
    import pandas as pd

    both = found.select("page", "n", "text", F.lit("t").alias("side")).unionAll(blocks.select("page", "n", "text", F.lit("b").alias("side")))

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        from collections import Counter

        size = lambda s: len(s.encode("utf-16-le")) // 2
        p = p.assign(text=p.text.fillna(""))
        given, asked = p[p.side == "b"].sort_values("n"), p[p.side == "t"].sort_values("n")
        texts, numbers = given.text.tolist(), given.n.tolist()
        column: dict[str, int] = {}
        cells = [(row, column.setdefault(c, len(column)), k) for row, t in enumerate(texts) for c, k in Counter(t).items()]
        counts = np.zeros((len(texts), len(column)), np.int32, order="F")
        if cells:
            rows, cols, values = map(np.array, zip(*cells))
            counts[rows, cols] = values
        sizes, free = np.array([size(t) for t in texts], np.int64), np.ones(len(texts), bool)
        out = []
        for page, n, text in zip(asked.page.tolist(), asked.n.tolist(), asked.text.tolist()):
            mine = [(column[c], k) for c, k in Counter(text).items() if c in column]
            if not mine or not free.any():
                continue
            shared = np.minimum(counts[:, [c for c, _ in mine]], np.array([k for _, k in mine], np.int32)).sum(1)
            score = np.where(free, shared / np.maximum(np.maximum(sizes, size(text)), 1), -1.0)
            best = int(score.argmax())
            if score[best] > 0 and score[best] >= least:
                free[best] = False
                out.append((page, n, numbers[best], float(score[best]), texts[best] == text))
        return pd.DataFrame(out, columns=["page", "n", "block", "score", "same"])

    return both.groupBy("page").applyInPandas(fold, "page long, n long, block long, score double, same boolean")
