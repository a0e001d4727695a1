"""Reading the input tables and writing intermediate ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only on one machine where the session names no shared folder, as in tests.
FALLBACK_DIR = "file:///tmp/cribra-shared"
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor reaches: spark.checkpoint.dir. A cluster needs it; one machine has a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or FALLBACK_DIR).rstrip("/") + "/cribra"


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append(path)
    return path


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, none if there is no such folder."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def move_path(spark: SparkSession, path: str, to: str) -> None:
    fs, p = _fs(spark, path)
    to = spark._jvm.org.apache.hadoop.fs.Path(to)
    fs.mkdirs(to.getParent())
    if not fs.rename(p, to):
        raise OSError(f"{path} can't be moved to {to}")


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this process. For callers that have written or collected their results."""
    while _WRITTEN:
        delete_path(spark, _WRITTEN.pop())


def materialize(df: DataFrame, label: str, partitions: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if partitions:
        df = df.coalesce(partitions)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Stands for a missing whole number on the way through pandas, which would turn a column with nulls, and the numbers beside
#: them, into floats.
NO_NUMBER = -(1 << 63)


def filled(c: str):
    """A long column with NO_NUMBER for null; see emptied."""
    from pyspark.sql import functions as F

    return F.coalesce(F.col(c).cast("long"), F.lit(NO_NUMBER)).alias(c)


def emptied(c: str):
    from pyspark.sql import functions as F

    return F.nullif(F.col(c), F.lit(NO_NUMBER)).alias(c)


def table_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate, from file sizes for a table just read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit_bytes: int = 16 << 20) -> DataFrame:
    """Hint a broadcast only when the size on disk is proven to be below the limit; else leave the join to Spark.

    Meant for tables that were written before (see materialize), whose size is known from their files.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if table_bytes(df) <= limit_bytes else df
