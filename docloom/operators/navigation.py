"""C11: where a reader lands who opens a chapter without content.

The target is the first chapter with content among the empty one's descendants on its page, each reached over chapters of that
page alone, else among its later siblings of that page and theirs. With chapters in preorder, and those of one page that hang
together (or below one parent) as a group, that is the next one with content of the group, if it is still below the parent: a
window, however deep the tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.shared import written


def placed(chapters: DataFrame) -> DataFrame:
    """Adds ``path``, the places among siblings from the root, and ``pages``, the pages along it; what no root reaches, or a ring, is left out."""
    step = ["doc_id", "id", "parent", "ord", "page", "contents"]
    tree = chapters.select(*step)
    now = written(tree.where("parent is null").select(*step, F.array("ord").alias("path"), F.array("page").alias("pages")), "chapters")
    levels = [now]
    while not now.isEmpty():
        up = now.select("doc_id", F.col("id").alias("parent"), F.col("path").alias("up_path"), F.col("pages").alias("up_pages"))
        now = written(tree.join(up, ["doc_id", "parent"]).select(*step, F.concat("up_path", F.array("ord")).alias("path"), F.concat("up_pages", F.array("page")).alias("pages")), "chapters")
        levels.append(now)
    out = levels[0]
    for more in levels[1:-1]:
        out = out.unionByName(more)
    return out


def redirects(chapters: DataFrame) -> DataFrame:
    """doc_id, id, target: chapters (doc_id, id, parent, ord, page, contents) without contents and where they lead, null for nowhere.

    Siblings' ``ord`` differ. Chapters without page stand on no page and lead nowhere.
    """
    run = F.aggregate(F.reverse("pages"), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, p: F.struct(F.when(a["on"] & (p == F.col("page")), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["on"] & F.coalesce(p == F.col("page"), F.lit(False))).alias("on")))["n"]
    p = placed(chapters).withColumn("group", F.slice("path", F.lit(1), F.size("path") - run))
    ahead = Window.partitionBy("doc_id", "page", "group").orderBy("path").rowsBetween(1, Window.unboundedFollowing)
    full = F.when(F.col("contents") > 0, F.struct("id", "path"))
    n = p.withColumn("next", F.first(full, ignorenulls=True).over(ahead)).where(F.col("contents") == 0)
    inside = F.slice(F.col("next.path"), F.lit(1), F.size("path") - 1) == F.slice("path", F.lit(1), F.size("path") - 1)
    return n.select("doc_id", "id", F.when(inside & F.col("page").isNotNull(), F.col("next.id")).alias("target"))
