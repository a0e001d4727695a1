"""Incremental runs with Structured Streaming: checkpoints in place of cursors, a ledger in place of an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cribra.functions import text
from cribra.operators import ledger
from cribra.tables import delete_path, path_exists


def source(spark: SparkSession, path: str, schema: StructType, fmt: str = "json", files: int | None = None) -> DataFrame:
    """A stream of a folder's files, or of one file; files bounds how many a batch takes, the throttle of a run."""
    r = spark.readStream.schema(schema).format(fmt)
    if files:
        r = r.option("maxFilesPerTrigger", files)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        r, path = r.option("pathGlobFilter", p.getName()), p.getParent().toString()
    return r.load(path)


def clean(stream: DataFrame, least: int = 300) -> DataFrame:
    df = text.barrier(stream, "clean", text.clean_article(F.col("text")))
    return df.where(F.length("clean") >= least)


def append_once(stream: DataFrame, out: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Everything that is there and wasn't written yet, exactly once, then stops. Delete both folders to start anew."""
    q = stream.writeStream.format(fmt).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()


def ledger_batches(stream: DataFrame, ledger_path: str, checkpoint: str, sink: Callable[[DataFrame, int], None], order: list[str]) -> None:
    """stream(url, content_hash, ...): each batch's new rows go to sink, then into the ledger, both under the batch's number.

    Data is written before the ledger and both overwrite their own batch, so a batch that is run again after a failure
    changes nothing. The rows of a batch's own number are left out of the ledger it is compared with.
    """
    spark = stream.sparkSession

    def one(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            known = batch.select("url", "content_hash").limit(0)
            if path_exists(spark, ledger_path):  # any other failure to read the ledger is one
                known = spark.read.parquet(ledger_path).where(F.col("batch") != n).select("url", "content_hash")
            new = ledger.accept(batch, known, order).persist()
            sink(new, n)
            new.select("url", "content_hash").write.mode("overwrite").parquet(f"{ledger_path}/batch={n}")
            new.unpersist()
        finally:
            batch.unpersist()

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def answered(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], good: str, dead: str, checkpoint: str, force: bool = False) -> None:
    """stream(response, ...): every row once, parsed by parse (which adds p), to good where p isn't null, else to dead.

    The checkpoint is the cursor: rows that failed aren't asked for again, but wait in dead. Each batch writes both under
    its number, so one that is run again changes nothing. force forgets the cursor and what was written.
    """
    spark = stream.sparkSession
    if force:
        for path in (good, dead, checkpoint):
            delete_path(spark, path)

    def one(batch: DataFrame, n: int) -> None:
        batch = parse(batch).persist()
        try:
            batch.where("p IS NOT NULL").drop("response").write.mode("overwrite").parquet(f"{good}/batch={n}")
            batch.where("p IS NULL").drop("p").write.mode("overwrite").parquet(f"{dead}/batch={n}")
        finally:
            batch.unpersist()

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
