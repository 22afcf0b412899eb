"""Tables and folders that the driver and all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place in the folder that ``spark.checkpoint.dir`` names; a master of this process alone has one of its own where that is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = f"file:///tmp/docloom-{os.getuid()}-{os.getpid()}"
    return f"{given.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: its lineage ends there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
