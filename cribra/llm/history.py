"""Deduplicating new batches against everything accepted before (problem 1).

The store holds one row for every key of an accepted record: the minwise band key, the minwise signature and digest that
settle a match, and the record's place in time. It lies in segments, one a batch, each partitioned by a hash of the band
key into as many buckets as its size asks for. Of a segment a batch reads only the buckets that its own band keys fall
into. Each time FAN segments of one level are there they are written into one of the next level, with more buckets, so a
key is written again a logarithmic number of times and the files stay few.

A record's page is the set of its address' tokens, its content a set of one hash. Equal sets have equal minwise values,
so no equal page or content falls outside its bucket; signature and digest must be equal too for a match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cribra.llm.addresses import content_key, instant, with_page
from cribra.operators.ledger import ONE_TASK, later_repeats
from cribra.tables import broadcast_if_small, delete_path, emptied, filled, list_names, materialize, move_path, path_exists, scratch_path

#: Minwise values in a band.
ROWS_PER_BAND = 4
#: A segment's buckets are a power of two: of about so many keys each, and never more than the second figure.
KEYS_PER_BUCKET, MOST_BUCKETS = 65_536, 4096
#: Segments of a level that are merged into one of the next.
FAN = 8
KEYS = "band long, values array<long>, sign binary, at long, id long"
_SEGMENT = re.compile(r"^seg-(\d+)-(\d+)-(\d+)$")


def signature(tokens: Column) -> Column:
    """ROWS_PER_BAND minwise values of a set of tokens."""
    return F.array(*[F.array_min(F.transform(tokens, lambda t, s=s: F.xxhash64(t, F.lit(s)))) for s in range(ROWS_PER_BAND)])


def record_keys(df: DataFrame) -> DataFrame:
    """(scrape_id, url, content_hash, scraped_at) -> (id, at, band, values, sign), a row for each key, none for a record without any.

    A record whose time can't be read comes last. Null or blank urls, and hashes that say nothing, are no keys.
    """
    at = F.unix_micros(F.coalesce(instant(F.col("scraped_at")), F.lit("9999-01-01").cast("timestamp")))  # as a number, for any year
    df = df.select(filled("scrape_id").alias("id"), at.alias("at"), "url", content_key(F.col("content_hash")).alias("content"))
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("page").alias("key")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("key")))
    df = with_page(df, F.col("url"), "page").select("id", "at", F.explode(both).alias("k")).where("k.key IS NOT NULL")
    tokens = F.when(F.col("k.kind") == 0, F.split("k.key", r"[/?&=-]")).otherwise(F.array("k.key"))
    df = df.select("id", "at", "k.kind", F.explode(F.array(signature(tokens))).alias("values"), F.unhex(F.md5(F.concat_ws(":", "k.kind", "k.key"))).alias("sign"))
    return df.select("id", "at", F.xxhash64("kind", "values").alias("band"), "values", "sign")


class History:
    """Accepted records' keys under a path of the shared folder. All state is there: a new object goes on where another ended."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "history")
        #: Buckets read by the last probe, and buckets that there were.
        self.read = (0, 0)
        self._segments: dict[tuple[int, int, int], list[str]] | None = None

    def segments(self) -> dict[tuple[int, int, int], list[str]]:
        """(level, number, buckets) of the segments that were written to their end, with the names of their buckets that hold
        keys. Listed once by each object, which then keeps account of what it writes itself; a store has one writer."""
        if self._segments is None:
            found = [tuple(map(int, m.groups())) for m in map(_SEGMENT.match, list_names(self.spark, self.path)) if m]
            self._segments = {s: self._buckets(s) for s in found if path_exists(self.spark, f"{self._at(s)}/_SUCCESS")}
        return self._segments

    def _buckets(self, s: tuple[int, int, int]) -> list[str]:
        return [b for b in list_names(self.spark, self._accepted(s)) if b.startswith("bucket=")]

    def _at(self, s: tuple[int, int, int]) -> str:
        return f"{self.path}/seg-{s[0]}-{s[1]}-{s[2]}"

    def _accepted(self, s: tuple[int, int, int]) -> str:
        """Of a segment the accepted records' keys; beside them lie the ids of the batch's repeats."""
        return f"{self._at(s)}/again=false"

    def probe(self, keys: DataFrame) -> DataFrame | None:
        """(id) of keys(id, at, band, values, sign) that an earlier accepted record holds too, null for an empty store."""
        segments = self.segments()
        if not segments:
            return None
        most = max(b for _, _, b in segments)
        # of at most MOST_BUCKETS; a segment's bucket is the last bits of that of any larger one
        asked = {r[0] for r in keys.select(_bucket(most)).distinct().collect()} if most > 1 else {0}
        paths, read = [], 0
        for s, held in segments.items():
            mine = {k % s[2] for k in asked}
            read += len(mine)
            paths += [f"{self._accepted(s)}/{b}" for b in held if int(b[7:]) in mine]
        self.read = (read, sum(b for _, _, b in segments))
        if not paths:
            return None
        parts = self.spark.read.schema(KEYS).parquet(*paths)
        known = parts.select("band", F.col("values").alias("v"), F.col("sign").alias("s"), F.struct("at", "id").alias("first"))
        hit = known.join(broadcast_if_small(keys), "band").where((F.col("v") == F.col("values")) & (F.col("s") == F.col("sign")) & (F.col("first") < F.struct("at", "id")))
        return hit.select("id")

    def _write(self, rows: DataFrame, n: int, level: int, number: int | None = None) -> tuple[int, int, int]:
        """Writes rows(again, band, values, sign, at, id), at most n, as a segment, and merges what is to be merged."""
        buckets = 1
        while buckets * KEYS_PER_BUCKET < n and buckets < MOST_BUCKETS:
            buckets *= 2
        if number is None:
            number = 1 + max((k for _, k, _ in self.segments()), default=-1)
        s = level, number, buckets
        rows = rows.select("again", _bucket(buckets).alias("bucket"), "band", "values", "sign", "at", "id")
        # few rows are one file a bucket from one task already
        rows = rows if n <= ONE_TASK else rows.repartition(buckets, "again", "bucket")
        rows.write.mode("overwrite").partitionBy("again", "bucket").parquet(self._at(s))
        self.segments()[s] = self._buckets(s)
        return s

    def _merge(self) -> None:
        level = 0
        while len(full := [s for s in self.segments() if s[0] == level]) >= FAN:
            at = [f"{self._accepted(s)}/{b}" for s in full for b in self.segments()[s]]
            rows = self.spark.read.schema(KEYS).parquet(*at) if at else self.spark.createDataFrame([], KEYS)
            rows = materialize(rows.withColumn("again", F.lit(False)), "history-merge")
            n = rows.count()
            self._write(rows.coalesce(1) if n <= ONE_TASK else rows, n, level + 1, max(k for _, k, _ in full))
            for s in full:
                delete_path(self.spark, self._at(s))  # until then its keys are there twice, which changes nothing
                del self.segments()[s]
            level += 1

    def batch(self, df: DataFrame) -> DataFrame:
        """df(scrape_id, url, content_hash, scraped_at) -> (id) of those that only repeat an accepted record; see batch_keys."""
        keys = materialize(record_keys(df), "batch-keys")
        out = scratch_path(self.spark, "batch-again")
        self.batch_keys(keys, keys.count(), out)
        return _ids(self.spark, out)

    def batch_keys(self, keys: DataFrame, n: int, out: str) -> None:
        """Of keys(id, at, band, values, sign), n rows, those of records that only repeat an accepted one go to the folder out;
        the others are accepted and remembered.

        Within the batch the records are taken in order of time, then id; records without any key are accepted. A batch of
        at most ONE_TASK keys is taken in order by one task, a larger one as later_repeats does it, with the same result:
        there a key that a third of all records hold is one row of a partial aggregate and one side of a join split where
        skewed.
        """
        old = self.probe(keys)
        if n <= ONE_TASK:
            rows = keys.withColumn("old", F.lit(False))
            if old is not None:
                rows = old.select("id", *[F.lit(0 if t == "bigint" else None).cast(t).alias(c) for c, t in keys.dtypes if c != "id"], F.lit(True).alias("old")).select(rows.columns).union(rows)
            schema = ", ".join(f"{c} {t}" for c, t in keys.dtypes) + ", again boolean"
            s = self._write(rows.coalesce(1).sortWithinPartitions(F.desc("old"), "at", "id").mapInPandas(_in_order, schema), n, 0)
            if path_exists(self.spark, f"{self._at(s)}/again=true"):
                move_path(self.spark, f"{self._at(s)}/again=true", out)
        else:
            left = keys
            if old is not None:
                old = materialize(old.distinct(), "batch-old")
                left = keys.join(broadcast_if_small(old), "id", "left_anti")
            again = materialize(later_repeats(left.select("id", "at", F.col("sign").alias("key"))), "batch-again")
            self._write(left.join(broadcast_if_small(again), "id", "left_anti").withColumn("again", F.lit(False)), n, 0)
            (again if old is None else old.union(again)).write.mode("overwrite").parquet(out)
        self._merge()


def _ids(spark: SparkSession, path: str) -> DataFrame:
    """(id) of the repeats written under a folder, none if there is no such folder."""
    return spark.read.schema("id long").option("recursiveFileLookup", True).parquet(path).distinct() if path_exists(spark, path) else spark.createDataFrame([], "id long")


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that only name an old repeat first, then the batch's in order; gives the latter with whether they repeat."""
    old: set[int] = set()
    taken: set[bytes] = set()
    last, mine, again = None, [], False
    held: list[pd.DataFrame] = []
    for pdf in batches:
        old.update(pdf["id"][pdf["old"]].tolist())
        held.append(pdf[~pdf["old"]].drop(columns="old"))
    rows = pd.concat(held, ignore_index=True)
    out = np.zeros(len(rows), bool)
    at: list[int] = []
    for k, (i, sign) in enumerate(zip(rows["id"].tolist(), rows["sign"].tolist())):
        if i != last:
            if not again:
                taken.update(mine)
            out[at] = again
            last, mine, at, again = i, [], [], i in old
        at.append(k)
        mine.append(sign)
        again = again or sign in taken
    out[at] = again
    yield rows.assign(again=out)


def _bucket(n: int) -> Column:
    return F.col("band").bitwiseAND(n - 1).cast("int")


def repeats(df: DataFrame, path: str | None = None) -> DataFrame:
    """(scrape_id) of all records that repeat an accepted one.

    The days (UTC) go through the store in order, a batch each. Ties in time go by id. Null url and null or empty hash
    are no keys. An empty table gives no rows. Keys are made in one pass over the table, which writes them by day.
    """
    spark = df.sparkSession
    keyed = scratch_path(spark, "keys-by-day")
    keys = record_keys(df).withColumn("day", F.date_format(F.timestamp_micros("at"), "yyyyMMdd"))
    keys.repartition("day").write.mode("overwrite").partitionBy("day").parquet(keyed)
    schema = "id long, at long, band long, values array<long>, sign binary"
    size = {r["day"]: r["count"] for r in spark.read.schema(schema + ", day string").parquet(keyed).groupBy("day").count().collect()}  # a row a day
    history, out = History(spark, path), scratch_path(spark, "repeats")
    for day in sorted(size):
        history.batch_keys(spark.read.schema(schema).parquet(f"{keyed}/day={day}"), size[day], f"{out}/{day}")
    return _ids(spark, out).select(emptied("id").alias("scrape_id"))
