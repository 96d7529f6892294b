"""The folder that the driver and all executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quantide.params import ConfigurationError


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder below ``spark.checkpoint.dir``; a session in local mode without one gets its own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigurationError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quantide-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written once and read back: what builds on it doesn't compute it again, and it outlives executors."""
    path = shared_folder(df.sparkSession, f"tables/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
