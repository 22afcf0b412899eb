"""What the training-data operators share: shared-folder tables, word rules, digests, folds."""

from __future__ import annotations

import gc
import os
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the map that tells rows which can't be among some ids from those that may; 64 to a row.
MAP_BITS = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``.

    Where it is unset a master that runs in this process alone, as tests do, gets one of its own; any other has to name it.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file:///tmp/docloom-{os.getuid()}-{os.getpid()}"


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, and any executor can be lost."""
    path = new_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder once nothing reads it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of the shared folder that are deleted when the work that needs them is done."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = new_dir(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        made = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(made)] = (made, path)
        return made

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if (found := self.paths.pop(id(t), None)) is not None:
                drop_dir(self.spark, found[1])

    def release(self) -> None:
        """Lets go of what finished queries hold: their shuffle files are deleted when the driver's references are collected."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop_all(self) -> None:
        self.drop(*[t for t, _ in self.paths.values()])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fold_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def docs_only(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text read as empty: other columns may clash with what operators add."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def may_be_among(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` whose doc_id may be the one column of ``ids``, and those whose can't, told apart without a shuffle of ``docs``.

    A bit map of the hashed ids is broadcast: MAP_BITS bits in rows of 64, whatever the number of ids. The first part
    still has to be joined.
    """
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    hashed = ids.select(cell(F.col(ids.columns[0]).cast("long")).alias("c"))
    words = hashed.groupBy(F.shiftright("c", 6).alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(c & 63 as int)))").alias("__bits"))
    at = cell(F.col("doc_id").cast("long"))
    tagged = docs.join(F.broadcast(words), F.shiftright(at, 6) == F.col("__word"), "left")
    hit = F.coalesce(F.call_function("shiftrightunsigned", F.col("__bits"), at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return tagged.where(hit).select(*docs.columns), tagged.where(~hit).select(*docs.columns)


def spans_text(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    """(start, kind's place, end) triples as ``kind:start:end``, by start, then kind."""
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))
