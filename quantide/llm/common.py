"""What the operators share: input tables, the shared folder, size-checked joins."""

from __future__ import annotations

import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it has been counted and has no more rows than this.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a session in
    local mode may lack it; it then gets a folder of its own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import atexit

    made = tempfile.mkdtemp(prefix="quantide-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quantide/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: this cuts the lineage and outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Remove tables made by ``stored`` that are no longer needed."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            if "/quantide/" in str(path):
                fs = path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())
                fs.delete(path, True)


def fresh(name: str, *taken: list[str]) -> str:
    """The name, lengthened until no column has it (whatever its case)."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name += "_"
    return name


def left_join_small(left: DataFrame, small: DataFrame, keys: list[str], limit: int = BROADCAST_ROWS, salts: int = 64) -> DataFrame:
    """Null-safe left join whose right side is expected to be small and has one row per key.

    The right side is counted (up to the limit). Within it, it is broadcast; its rows are to be short. Beyond
    it, the left side is dealt over salts, so that a key with a third of all rows is spread, and the right side is
    repeated once per salt. A salt is made of the row and of the number of its partition, so equal rows of many partitions are spread too,
    and a row that is computed again gets the same one. Other columns of the right side must not be named as columns of the left one.
    """
    taken = [*left.columns, *small.columns]
    theirs = {k: fresh(f"_r_{k}", taken) for k in keys}
    right = small.withColumnsRenamed(theirs)
    on = [left[k].eqNullSafe(right[theirs[k]]) for k in keys]
    if len(small.limit(limit + 1).select(F.lit(1)).collect()) <= limit:
        return left.join(F.broadcast(right), on, "left").drop(*theirs.values())
    ours, other = fresh("_salt", taken), fresh("_salt_r", taken)
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c, t in left.dtypes if "map<" not in t and t != "variant"], F.spark_partition_id())
    left = left.withColumn(ours, F.pmod(hashed, F.lit(salts)).cast("int"))
    right = right.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = [left[k].eqNullSafe(right[theirs[k]]) for k in keys] + [left[ours] == right[other]]
    return left.join(right, on, "left").drop(ours, other, *theirs.values())


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
