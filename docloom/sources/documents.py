"""Reading and writing raw documents, archives, page images and the task store."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<l:double,t:double,r:double,b:double,coord_origin:string>"
PROV = f"array<struct<page_no:int,bbox:{BOX},charspan:array<int>>>"
REFS = "array<struct<`$ref`:string>>"
CELL = f"struct<bbox:{BOX},row_span:int,col_span:int,start_row_offset_idx:int,end_row_offset_idx:int,start_col_offset_idx:int,end_col_offset_idx:int,text:string,column_header:boolean,row_header:boolean,row_section:boolean,fillable:boolean>"
NODE = f"self_ref:string,parent:struct<`$ref`:string>,children:{REFS},content_layer:string,label:string"
PAGE = "struct<page_no:int,size:struct<width:double,height:double>,image:struct<mimetype:string,dpi:int,size:struct<width:double,height:double>,uri:string>>"

#: The raw document; hashes are kept as decimals, which hold unsigned 64-bit integers.
RAW_SCHEMA = (
    "schema_name string, version string, name string, origin struct<mimetype:string,binary_hash:decimal(20,0),filename:string>, "
    f"body struct<self_ref:string,children:{REFS},content_layer:string,name:string,label:string>, furniture struct<self_ref:string,children:{REFS},content_layer:string,name:string,label:string>, "
    f"groups array<struct<{NODE},name:string>>, texts array<struct<{NODE},prov:{PROV},orig:string,text:string,level:int,enumerated:boolean,marker:string>>, "
    f"pictures array<struct<{NODE},prov:{PROV},captions:{REFS},image:struct<uri:string,mimetype:string>>>, "
    f"tables array<struct<{NODE},prov:{PROV},captions:{REFS},data:struct<table_cells:array<{CELL}>,num_rows:int,num_cols:int,grid:array<array<{CELL}>>>>>, pages map<string,{PAGE}>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row a JSON file, with its path as doc_id; broken files fail the read."""
    return spark.read.schema(RAW_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("doc_id", F.col("_metadata.file_path"))


def texts(raw: DataFrame) -> DataFrame:
    """Text nodes; the page is that of the first provenance, 1 without."""
    n = raw.select("doc_id", F.posexplode("texts").alias("ord", "n")).select("doc_id", "ord", "n.*")
    return n.select("doc_id", "ord", "self_ref", F.col("parent.`$ref`").alias("parent_ref"), "label", "content_layer", F.coalesce(F.get("prov", F.lit(0))["page_no"], F.lit(1)).alias("page_no"), "prov", "text", "orig", "level", "enumerated", "marker")


def body_texts(raw: DataFrame) -> DataFrame:
    """What chapters are made of."""
    from docloom.functions.text import is_valid, normalize

    t = texts(raw).where(F.col("label").isin("text", "section_header", "list_item") & ~F.coalesce(F.startswith("parent_ref", F.lit("#/pictures/")), F.lit(False)))
    return t.where(is_valid(F.col("text"))).withColumn("text", normalize(F.col("text")))


def footnotes(raw: DataFrame) -> DataFrame:
    """P2."""
    from docloom.functions.text import is_valid

    return texts(raw).where((F.col("label") == "footnote") & is_valid(F.col("text")))


def pictures(raw: DataFrame) -> DataFrame:
    """File names follow the place in the array; the page is 0 without provenance."""
    n = raw.select("doc_id", F.posexplode("pictures").alias("ord", "n")).select("doc_id", "ord", "n.*")
    return n.select("doc_id", "ord", "self_ref", F.coalesce(F.get("prov", F.lit(0))["page_no"], F.lit(0)).alias("page_no"), F.get("prov", F.lit(0))["bbox"].alias("bbox"), F.transform("captions", lambda c: F.struct(c["$ref"].alias("ref"), F.lit(None).cast("string").alias("text"))).alias("captions"), F.format_string("images/image_%d.png", F.col("ord")).alias("path"))


def tables(raw: DataFrame) -> DataFrame:
    """P4."""
    n = raw.select("doc_id", F.posexplode("tables").alias("ord", "n")).select("doc_id", "ord", "n.*")
    return n.select("doc_id", "ord", "self_ref", "label", F.coalesce(F.get("prov", F.lit(0))["page_no"], F.lit(0)).alias("page_no"), F.transform("captions", lambda c: F.struct(c["$ref"].alias("ref"), F.lit(None).cast("string").alias("text"))).alias("captions"), "data")


def grid_cells(raw: DataFrame) -> DataFrame:
    """The grid's cells one a row, with offsets that may be missing."""
    rows = tables(raw).select(F.concat_ws("|", "doc_id", "self_ref").alias("table_id"), F.posexplode("data.grid").alias("row", "cells"))
    c = rows.select("table_id", F.col("row").cast("long"), F.posexplode("cells").alias("col", "c"))
    return c.select("table_id", "row", F.col("col").cast("long"), F.col("c.start_row_offset_idx").cast("long").alias("start_row"), F.col("c.start_col_offset_idx").cast("long").alias("start_col"), F.col("c.row_span").alias("row_span"), F.col("c.col_span").alias("col_span"), F.col("c.text").alias("text"))


def page_table(raw: DataFrame) -> DataFrame:
    """Pages by their number."""
    p = raw.select("doc_id", F.explode("pages").alias("key", "p"))
    return p.select("doc_id", F.coalesce(F.col("p.page_no"), F.col("key").try_cast("int")).alias("page_no"), F.col("p.size.width").alias("width"), F.col("p.size.height").alias("height"), F.col("p.image.uri").alias("image_uri"))


def edges(raw: DataFrame) -> DataFrame:
    """Containers and their children, in order; body before furniture before groups."""
    def side(owner: Column, children: Column, rank: int) -> DataFrame:
        return raw.select("doc_id", F.lit(rank).alias("rank"), owner.alias("parent_ref"), F.posexplode(children).alias("child_pos", "c")).select("doc_id", "rank", "parent_ref", "child_pos", F.col("c.`$ref`").alias("child_ref"))

    groups = raw.select("doc_id", F.explode("groups").alias("g")).select("doc_id", F.lit(2).alias("rank"), F.col("g.self_ref").alias("parent_ref"), F.posexplode("g.children").alias("child_pos", "c"))
    return side(F.lit("#/body"), F.col("body.children"), 0).unionByName(side(F.lit("#/furniture"), F.col("furniture.children"), 1)).unionByName(groups.select("doc_id", "rank", "parent_ref", "child_pos", F.col("c.`$ref`").alias("child_ref")))


IMAGE = "data:image/png;base64,"


def embedded_images(text: Column) -> Column:
    """The embedded images of a JSON or HTML text, in order, as base64."""
    return F.regexp_extract_all(text, F.lit(IMAGE + r"([A-Za-z0-9+/=]*)"), F.lit(1))


def with_image_files(text: Column, prefix: str = "images/image_") -> Column:
    """The n-th embedded image becomes the path of its file."""
    parts = F.split(text, IMAGE + "[A-Za-z0-9+/=]*")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(prefix), (i - 1).cast("string"), F.lit(".png"), p))), "")


def decoded(image: Column) -> Column:
    """S7."""
    return F.unbase64(image)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The first JSON and the first HTML member of each ZIP file; one that lacks either has an error instead."""
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, data in zip(b.path, b.content):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        first = {e: next((n for n in z.namelist() if n.endswith(e)), None) for e in (".json", ".html")}
                        missing = [e for e, n in first.items() if n is None]
                        texts_ = [z.read(n).decode() if n else None for n in first.values()]
                        out.append((p, *texts_, f"missing {', '.join(missing)}" if missing else None))
                except zipfile.BadZipFile as e:
                    out.append((p, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "json", "html", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "path string, json string, html string, error string")


def page_images(spark: SparkSession, path: str) -> DataFrame:
    """Rendered pages, by the number in their names."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.regexp_extract("path", r"page_(\d+)", 1).try_cast("int").alias("page_no"), "path", "content").where("page_no is not null")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of a folder's files."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_json(df: DataFrame, path: str) -> None:
    """Written beside the input, never over it."""
    df.write.mode("errorifexists").json(path)


# The store's tables; statuses are partitions, the other lookups go by sort order
TASK_DDL = """CREATE TABLE IF NOT EXISTS {db}tasks (task_id STRING, filename STRING, options_json STRING, created_at TIMESTAMP, completed_at TIMESTAMP,
  session_id STRING, is_sample BOOLEAN, error STRING, status STRING) USING parquet PARTITIONED BY (status)"""
LOG_DDL = "CREATE TABLE IF NOT EXISTS {db}task_logs (id BIGINT, task_id STRING, level STRING, message STRING, ts TIMESTAMP) USING parquet"


def create_store(spark: SparkSession, database: str = "") -> None:
    """S20."""
    db = f"{database}." if database else ""
    for ddl in (TASK_DDL, LOG_DDL):
        spark.sql(ddl.format(db=db))


def options_of(column: Column) -> Column:
    """Embedded options as a map of strings; broken JSON is null."""
    return F.from_json(column, "map<string,string>", {"mode": "PERMISSIVE"})


def read_checkpoint(text: str | None, run_id: str, version: int = 1) -> dict:
    """A checkpoint of this run and version, else an empty one."""
    empty = {"version": version, "run_id": run_id, "completed": [], "failed": []}
    try:
        found = json.loads(text or "")
    except ValueError:
        return empty
    return found if isinstance(found, dict) and found.get("version") == version and found.get("run_id") == run_id else empty


def is_uuid(text: str) -> bool:
    """V15."""
    return re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", text, re.I) is not None
