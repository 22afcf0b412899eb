"""The node graph: explosion of raw documents, reference resolution, reading order, spatial and textual joins, chunk merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.chapters import subtree
from docloom.sources.shared import written

KINDS = ("texts", "pictures", "tables", "groups")


def exploded(raw: DataFrame, kind: str) -> DataFrame:
    """G1: the nodes of one kind of raw documents (doc_id, texts, pictures, ...), with their ordinals; of a repeated reference the last counts."""
    n = raw.select("doc_id", F.posexplode(kind).alias("ordinal", "node")).select("doc_id", "ordinal", "node.*")
    last = n.groupBy("doc_id", "self_ref").agg(F.max("ordinal").alias("ordinal"))
    return n.join(last, ["doc_id", "self_ref", "ordinal"], "left_semi")


def collection_of(ref: Column) -> Column:
    """The collection that a reference names, null for other text."""
    found = F.regexp_extract(ref, r"^#/(\w+)/", 1)
    return F.when(found != "", found)


def resolved(refs: DataFrame, nodes: DataFrame, ref: str = "ref") -> DataFrame:
    """The node columns of each reference, null where it points nowhere; the references' rows and order columns stay."""
    right = nodes.withColumnRenamed("self_ref", "__ref")
    return refs.join(right, (refs["doc_id"] == right["doc_id"]) & (refs[ref] == right["__ref"]), "left").drop(right["doc_id"]).drop("__ref")


def unresolved(refs: DataFrame, nodes: DataFrame, ref: str = "ref") -> DataFrame:
    """The references that no node has."""
    known = nodes.select("doc_id", F.col("self_ref").alias(ref))
    return refs.join(known, ["doc_id", ref], "left_anti")


def edges(nodes: DataFrame) -> DataFrame:
    """Parent, child and place of nodes with ``children`` (array of struct<ref>)."""
    return nodes.select("doc_id", F.col("self_ref").alias("parent_ref"), F.posexplode("children").alias("child_pos", "c")).select("doc_id", "parent_ref", F.col("c.ref").alias("child_ref"), "child_pos")


def reading_order(nodes: DataFrame) -> DataFrame:
    """Depth-first place of nodes (doc_id, id, parent, ordinal), however deep; what no container reaches follows in its own order."""
    reached = subtree(nodes).select("doc_id", "id", F.lit(0).alias("rest"), "path")
    rest = nodes.join(reached, ["doc_id", "id"], "left_anti").select("doc_id", "id", F.lit(1).alias("rest"), F.array(F.col("ordinal").cast("long")).alias("path"))
    order = Window.partitionBy("doc_id").orderBy("rest", "path", "id")
    return reached.unionByName(rest).select("doc_id", "id", F.row_number().over(order).alias("reading_order"))


def nearest_container(nodes: DataFrame) -> DataFrame:
    """The first group or table above each node (doc_id, self_ref, parent_ref), however far above.

    Every turn a node that hasn't met one jumps to where the node it has reached has jumped.
    """
    met = F.coalesce(F.col("at"), F.lit("")).rlike("^#/(groups|tables)/")
    now = nodes.select("doc_id", "self_ref", F.col("parent_ref").alias("at"), F.lit(0).alias("turn"))
    turn = 0
    while not (climbing := now.where(F.col("at").isNotNull() & ~met)).isEmpty() and turn < 40:  # whoever climbs then runs in a ring
        turn += 1
        on = now.select(F.col("doc_id").alias("__d"), F.col("self_ref").alias("__r"), F.col("at").alias("__at"))
        step = climbing.join(on, (F.col("doc_id") == F.col("__d")) & (F.col("at") == F.col("__r")), "left").select("doc_id", "self_ref", F.col("__at").alias("at"), F.lit(turn).alias("turn"))
        now = written(now.where(F.col("at").isNull() | met).unionByName(step), "containers")
    return now.where(met).select("doc_id", "self_ref", F.col("at").alias("container"))


def following_sibling(edges_: DataFrame, wanted: Column, reach: int = 3) -> DataFrame:
    """Of the next ``reach`` siblings the first that is wanted."""
    ahead = Window.partitionBy("doc_id", "parent_ref").orderBy("child_pos").rowsBetween(1, reach)
    return edges_.withColumn("next_ref", F.first(F.when(wanted, F.col("child_ref")), ignorenulls=True).over(ahead))


def preceding_on_page(items: DataFrame, column: str, name: str) -> DataFrame:
    """The last value before each item on its page."""
    before = Window.partitionBy("doc_id", "page_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn(name, F.last(column, ignorenulls=True).over(before))


def not_contained(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks that the text of their page's tables doesn't hold."""
    body = tables.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("__body"))
    joined = blocks.join(body, ["doc_id", "page_no"], "left")
    return joined.where(F.col("__body").isNull() | ~F.contains(F.col("__body"), F.col("text"))).drop("__body")


def joined_captions(owners: DataFrame, texts: DataFrame, separator: str = " ") -> DataFrame:
    """The captions' trimmed texts in order; owners are (doc_id, self_ref, captions: array of struct<ref, text>).

    A caption given as text stands for itself; a reference that points nowhere adds nothing.
    """
    c = owners.select("doc_id", "self_ref", F.posexplode("captions").alias("pos", "c")).select("doc_id", "self_ref", "pos", F.col("c.ref").alias("ref"), F.col("c.text").alias("given"))
    known = texts.select("doc_id", F.col("self_ref").alias("ref"), F.trim("text").alias("found"))
    parts = c.join(known, ["doc_id", "ref"], "left").withColumn("part", F.coalesce(F.trim("given"), "found"))
    full = parts.groupBy("doc_id", "self_ref").agg(F.array_sort(F.collect_list(F.when(F.coalesce("part", F.lit("")) != "", F.struct("pos", "part")))).alias("p"))
    return full.select("doc_id", "self_ref", F.array_join(F.transform("p", lambda x: x["part"]), separator).alias("caption"))


def chunk_offsets(counts: DataFrame, names: dict[str, str]) -> DataFrame:
    """How many nodes of each kind the chunks before hold."""
    before = Window.partitionBy("doc_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("doc_id", "chunk", *(F.coalesce(F.sum(k).over(before), F.lit(0)).cast("long").alias(v) for k, v in names.items()))


def shifted_ref(ref: Column, kind: str, by: Column) -> Column:
    """``#/kind/n`` becomes ``#/kind/n+by``; other references stay."""
    n = F.regexp_extract(ref, rf"^#/{kind}/(\d+)$", 1)
    return F.when(n != "", F.concat(F.lit(f"#/{kind}/"), (n.try_cast("long") + by).cast("string"))).otherwise(ref)


def merged_pages(pages: DataFrame) -> DataFrame:
    """O1: of a page that several chunks hold the last counts."""
    return pages.groupBy("doc_id", "page_no").agg(F.max_by(F.struct(*(c for c in pages.columns if c not in ("doc_id", "page_no"))), "chunk").alias("p")).select("doc_id", "page_no", "p.*")
