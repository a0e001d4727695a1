"""Skipping what was seen: ledger anti-joins, first-wins deduplication, upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribra.tables import materialize


#: Rows with a key that others hold too, up to which one task takes them in order; more are settled in rounds.
ONE_TASK = 200_000


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by order; rows with a null key are all kept.

    Of rows that tie in the order one stays, always the same: ties go by a hash of all columns that can be hashed. A
    partial aggregate finds the first row, so a key that many rows share isn't gathered in one task.
    """
    none = F.lit(False)
    for k in keys:
        none = none | F.col(k).isNull()
    tie = F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t and t != "variant"])
    first = df.where(~none).groupBy(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*df.columns), F.struct(*order, tie)).alias("__first"))
    return first.select("__first.*").unionByName(df.where(none))


def later_repeats(keys: DataFrame) -> DataFrame:
    """keys(id, at, key) -> (id) of the rows that share a key with a row accepted before them.

    What a loop in order of (at, id) would pass over that accepts a row if no accepted row holds one of its keys, and so
    lets a key that only a passed-over row holds open for the next. Null keys equal nothing. Only keys of several rows
    are looked at. Up to ONE_TASK such rows are taken in order by one task. More are settled in rounds: a row that is the
    first open one under each of its keys is accepted, everything under those keys repeats it; a chain of rows that share
    keys pairwise takes a round for every few links if its order runs along it, but the logarithm of its length if not.
    """
    keys = keys.where("key IS NOT NULL").select("id", "at", "key").distinct()
    several = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    open_ = materialize(keys.join(several, "key", "left_semi"), "open-keys")
    kind = dict(open_.dtypes)["id"]
    if open_.count() <= ONE_TASK:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            taken: set = set()
            last, mine, again = None, [], []
            for pdf in batches:
                for i, k in zip(pdf["id"], pdf["key"]):
                    if i != last:
                        if mine and taken.isdisjoint(mine):
                            taken.update(mine)
                        elif mine:
                            again.append(last)
                        last, mine = i, []
                    mine.append(k)
            if mine and not taken.isdisjoint(mine):
                again.append(last)
            yield pd.DataFrame({"id": pd.Series(again)})

        return open_.coalesce(1).sortWithinPartitions("at", "id").select("id", "key").mapInPandas(run, f"id {kind}")
    found = None
    while not open_.isEmpty():
        first = open_.groupBy("key").agg(F.min(F.struct("at", "id")).alias("first"))
        state = materialize(open_.join(first, "key").select("id", "at", "key", (F.col("first.id") == F.col("id")).alias("is_first")), "open-round")
        taken = state.groupBy("id").agg(F.min("is_first").alias("all_first")).where("all_first").select("id")
        closed = state.join(taken, "id", "left_semi").select("key").distinct()
        again = materialize(state.join(closed, "key", "left_semi").select("id").distinct().join(taken, "id", "left_anti"), "open-repeats")
        found = again if found is None else found.union(again)
        open_ = materialize(state.select("id", "at", "key").join(again, "id", "left_anti").join(taken, "id", "left_anti"), "open-keys")
    return found


def not_in_ledger(df: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows whose key the ledger lacks. Null keys are kept: they equal nothing."""
    return df.join(ledger.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti").select(*df.columns)


def accept(df: DataFrame, ledger: DataFrame, order: list[str]) -> DataFrame:
    """New rows(url, content_hash, ...): neither url nor hash in the ledger or in a row accepted before, in order.

    Rows that tie in the order are taken in any order that stays the same. Null url and null hash equal nothing.
    """
    new = not_in_ledger(not_in_ledger(df, ledger, "url"), ledger, "content_hash")
    new = materialize(new.withColumn("__id", F.monotonically_increasing_id()), "candidates")
    both = F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(c[0]), F.col(c).cast("string"))) for c in ("url", "content_hash")])
    keys = new.select(F.col("__id").alias("id"), F.struct(*order).alias("at"), F.explode(both).alias("key"))
    return new.join(later_repeats(keys).withColumnRenamed("id", "__id"), "__id", "left_anti").select(*df.columns)


def upsert(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """The ledger with rows added whose url it lacks."""
    return ledger.unionByName(not_in_ledger(rows, ledger, "url").select(*ledger.columns))


def accept_limit(df: DataFrame, accepted: Column, group: list[str], order: list[str], most: int) -> DataFrame:
    """Rows up to and with the most-th accepted one of each group: what a loop that stops there has seen.

    The place of the most-th accepted row comes from the first `most` ones of each slice of a group, so no task gets a
    whole group, however large it is. Null is a group like any other; the order must be without ties.
    """
    place = F.struct(*order)
    if most < 1:
        return df.limit(0)
    top = _least(df.where(accepted).select(*group, place.alias("__at")), group, most)
    match = F.lit(True)
    left, right = df.withColumn("__at", place).alias("l"), top.alias("r")
    for g in group:
        match = match & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    return left.join(right, match, "left").where(F.col("r.__last").isNull() | (F.col("l.__at") <= F.col("r.__last"))).select("l.*").drop("__at")


def _least(df: DataFrame, group: list[str], most: int) -> DataFrame:
    """(group, __last): the most-th smallest __at of each group that has so many, by way of each slice's smallest ones."""
    from pyspark.sql import Window

    sliced = df.withColumn("__slice", F.pmod(F.xxhash64("__at"), F.lit(64)))
    rank = F.row_number().over(Window.partitionBy(*group, "__slice").orderBy("__at"))
    few = sliced.withColumn("__n", rank).where(F.col("__n") <= most).drop("__n", "__slice")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("__at"))
    return few.withColumn("__n", rank).where(F.col("__n") == most).select(*group, F.col("__at").alias("__last"))
