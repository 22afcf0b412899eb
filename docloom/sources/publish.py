"""Tables that readers see whole or not at all, their first state, and checkpoints of a run.

A published table is a folder of versions, which never change, and of small pointer files that name one. A writer writes a new
version and then renames a new pointer over the old one, in one step of the file system; a writer that fails leaves the pointer,
and so the table, as it was. A version that no pointer names is swept away by ``sweep``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

CURRENT, ORIGIN = "CURRENT", "ORIGIN"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _read(spark: SparkSession, path: str) -> str | None:
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and renames it over what is there."""
    jvm = spark.sparkContext._jvm
    fs, new = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(new, jvm.org.apache.hadoop.fs.Path(path), options)


def publish(df: DataFrame, path: str, **about) -> str:
    """Writes ``df`` as the table's new state; returns the version's name. ``about`` is kept with the pointer."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    _put(spark, f"{path}/{CURRENT}", json.dumps({"version": version, **about}))
    return version


def published(spark: SparkSession, path: str, pointer: str = CURRENT) -> DataFrame | None:
    """The table as last published, null if it never was."""
    found = _read(spark, f"{path}/{pointer}")
    return None if found is None else spark.read.parquet(f"{path}/{json.loads(found)['version']}")


def keep_origin(spark: SparkSession, path: str, name: str = ORIGIN) -> DataFrame | None:
    """Lets ``name`` point to the present state, unless it points to an earlier one already; returns that state."""
    if (present := _read(spark, f"{path}/{CURRENT}")) is not None and _read(spark, f"{path}/{name}") is None:
        _put(spark, f"{path}/{name}", present)
    return published(spark, path, name)


def rewrite(spark: SparkSession, path: str, change) -> str:
    """S3: publishes ``change(present state)``; the state that it reads stays readable meanwhile."""
    return publish(change(published(spark, path)), path)


def sweep(spark: SparkSession, path: str, pointers: tuple[str, ...] = (CURRENT, ORIGIN)) -> int:
    """Deletes versions that no pointer names; for times without writers and readers. Returns how many."""
    named = {json.loads(p)["version"] for x in pointers if (p := _read(spark, f"{path}/{x}")) is not None}
    fs, at = _fs(spark, path)
    lost = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("v-") and f.getPath().getName() not in named]
    for old in lost:
        fs.delete(old, True)
    return len(lost)


def write_checkpoint(df: DataFrame, path: str, run_id: str, schema_version: int) -> None:
    """A run's items as they stand."""
    publish(df, path, run_id=run_id, schema_version=schema_version)


def read_checkpoint(spark: SparkSession, path: str, run_id: str, schema_version: int, schema: str) -> DataFrame:
    """The items of this run and version; without any, of another run, or broken, none."""
    try:
        found = json.loads(_read(spark, f"{path}/{CURRENT}") or "{}")
    except ValueError:
        found = {}
    if not isinstance(found, dict) or found.get("run_id") != run_id or found.get("schema_version") != schema_version:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{found['version']}")
