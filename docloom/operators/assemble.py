"""Raw documents from flat elements of pages, the inverse of their explosion.

Elements are doc_id, page_no, ord, seq, type, content, level, marker, bbox (0-1, from the top left); sizes are doc_id, page_no,
width, height; names are doc_id, name, filename. References are dealt out by windows in reading order (page, ord, seq), captions go
to the last picture or table before them on their page, headers and footers become furniture. Elements without box, or on pages
without size, get a box of zeros; a caption with nothing before it belongs to nothing; pages that only have a size aren't
listed; documents without elements don't exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.commands import units

FURNITURE = ("page_header", "page_footer")
MEDIA = {"picture": "pictures", "table": "tables"}
DPI = 200
ROOT = "_root_"


def placed(elements: DataFrame, sizes: DataFrame) -> DataFrame:
    """Elements with their kind, ordinal, reference, place in the body or the furniture, provenance and, for captions, owner.

    A document's sizes come as one map, so that its elements are parted by document alone, once for all windows and groupings.
    """
    kind = F.when(F.col("type") == "picture", "pictures").when(F.col("type") == "table", "tables").otherwise("texts")
    order = Window.partitionBy("doc_id").orderBy("page_no", "ord", "seq")
    before = Window.partitionBy("doc_id", "page_no").orderBy("ord", "seq").rowsBetween(Window.unboundedPreceding, -1)
    sized = sizes.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page_no", F.struct("width", "height")))).alias("sizes"))
    size = F.try_element_at("sizes", F.col("page_no"))
    e = elements.join(sized, "doc_id", "left").select("*", size["width"].alias("width"), size["height"].alias("height")).withColumn("kind", kind)
    ordinal = F.lit(None).cast("long")
    for k in ("texts", "pictures", "tables"):
        ordinal = F.when(F.col("kind") == k, F.count_if(F.col("kind") == k).over(order) - 1).otherwise(ordinal)
    e = e.withColumn("place", F.row_number().over(order) - 1).withColumn("ordinal", ordinal)
    e = e.withColumn("self_ref", F.concat(F.lit("#/"), "kind", F.lit("/"), F.col("ordinal").cast("string"))).withColumn("layer", F.when(F.col("type").isin(*FURNITURE), "furniture").otherwise("body"))
    owner = F.last(F.when(F.col("kind") != "texts", F.col("self_ref")), ignorenulls=True).over(before)
    known = F.col("bbox").isNotNull() & F.col("width").isNotNull() & F.col("height").isNotNull()
    side = lambda c: F.when(known, c).otherwise(F.lit(0.0))
    box = F.struct(
        side(F.col("bbox.l") * F.col("width")).alias("l"), side((1 - F.col("bbox.t")) * F.col("height")).alias("t"), side(F.col("bbox.r") * F.col("width")).alias("r"), side((1 - F.col("bbox.b")) * F.col("height")).alias("b"), F.lit("BOTTOMLEFT").alias("coord_origin")
    )
    prov = F.array(F.struct(F.col("page_no").alias("page_no"), box.alias("bbox"), F.array(F.lit(0).cast("long"), units(F.coalesce("content", F.lit(""))).cast("long")).alias("charspan")))
    return e.withColumn("owner", F.when(F.col("type") == "caption", owner)).withColumn("prov", prov)


def _refs(condition: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("place", "self_ref")))), lambda x: F.struct(x["self_ref"].alias("ref")))


def _sorted(kind: str, *fields: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(F.col("ordinal"), F.struct(*fields).alias("node"))))), lambda x: x["node"])


def assembled(elements: DataFrame, sizes: DataFrame, names: DataFrame, dpi: int = DPI) -> DataFrame:
    """A row a document: doc_id, schema_name, version, name, origin, body, furniture, groups, texts, pictures, tables, pages."""
    p = placed(elements, sizes)
    nothing = F.array().cast("array<struct<ref:string>>")
    held = F.collect_list(F.when(F.col("owner").isNotNull(), F.struct("place", "self_ref"))).over(Window.partitionBy("doc_id", F.coalesce("owner", "self_ref")))
    p = p.withColumn("captions", F.transform(F.array_sort(held), lambda x: F.struct(x["self_ref"].alias("ref"))))
    listed = F.col("type") == "list_item"
    common = [F.col("self_ref"), nothing.alias("children"), F.lit("body").alias("content_layer"), F.col("type").alias("label"), F.col("prov")]
    texts = _sorted(
        "texts", *common, F.col("content").alias("orig"), F.col("content").alias("text"), F.when(F.col("type") == "section_header", F.col("level")).alias("level"),
        F.when(listed, F.coalesce(T.is_enumerated(F.col("marker")), F.lit(False))).alias("enumerated"), F.when(listed, F.col("marker")).alias("marker"),
    )
    media = [*common, F.col("captions"), nothing.alias("references"), nothing.alias("footnotes")]
    cells = "array<struct<row:int,col:int,text:string>>"
    data = F.struct(F.array().cast(cells).alias("table_cells"), F.lit(0).alias("num_rows"), F.lit(0).alias("num_cols"), F.array().cast(f"array<{cells}>").alias("grid"))
    root = lambda layer: F.struct(F.lit(f"#/{layer}").alias("self_ref"), _refs(F.col("layer") == layer).alias("children"), F.lit(layer).alias("content_layer"), F.lit(ROOT).alias("name"), F.lit("unspecified").alias("label"))
    d = p.groupBy("doc_id").agg(
        root("body").alias("body"), root("furniture").alias("furniture"), texts.alias("texts"), _sorted("pictures", *media, nothing.alias("annotations")).alias("pictures"), _sorted("tables", *media, data.alias("data")).alias("tables"),
        F.collect_set("page_no").alias("page_nos"), F.first("sizes").alias("sizes"),
    )

    def page(n: Column) -> Column:
        at = F.try_element_at("sizes", n)
        size = F.struct(F.coalesce(at["width"], F.lit(0.0)).alias("width"), F.coalesce(at["height"], F.lit(0.0)).alias("height"))
        return F.struct(n.cast("string"), F.struct(n.alias("page_no"), size.alias("size"), F.struct(F.lit("image/png").alias("mimetype"), F.lit(dpi).alias("dpi"), size.alias("size"), F.lit("").alias("uri")).alias("image")))

    d = d.withColumn("pages", F.map_from_entries(F.transform("page_nos", page)))
    origin = F.struct(F.lit("application/pdf").alias("mimetype"), F.lit(0).cast("decimal(20,0)").alias("binary_hash"), F.col("filename").alias("filename"))
    return d.join(names, "doc_id").select("doc_id", F.lit("DoclingDocument").alias("schema_name"), F.lit("1.0.0").alias("version"), "name", origin.alias("origin"), "body", "furniture", nothing.alias("groups"), "texts", "pictures", "tables", "pages")
