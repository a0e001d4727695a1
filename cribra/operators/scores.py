"""Axis scores: wide to long, distributions, rankings, sample sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cribra.axes import AXES


def axis_value(axis: str, labels: str | None = None) -> Column:
    """The root column, else the entry of a map column, else 0."""
    return F.coalesce(F.col(axis).cast("double"), *([F.col(labels)[axis].cast("double")] if labels else []), F.lit(0.0))


def to_long(df: DataFrame, keep: list[str], labels: str | None = None) -> DataFrame:
    """(keep..., axis_pos, axis, score), eight rows for one."""
    parts = F.array(*[F.struct(F.lit(i).alias("axis_pos"), F.lit(a).alias("axis"), axis_value(a, labels).alias("score")) for i, a in enumerate(AXES)])
    return df.select(*keep, F.explode(parts).alias("__s")).select(*keep, "__s.*")


def political(df: DataFrame) -> DataFrame:
    return df.where("is_political = 1")


def distribution(long: DataFrame) -> DataFrame:
    """Mean, population variance and deviation by axis."""
    return long.groupBy("axis").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.var_pop("score"), 6).alias("var"), F.round(F.stddev_pop("score"), 6).alias("std"))


def threshold_counts(long: DataFrame, thresholds=(0.3, 0.5, 0.7)) -> DataFrame:
    t = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(float(x)).alias("threshold")) for i, x in enumerate(thresholds)])).alias("t")
    return long.select("axis", "score", t).groupBy("axis", F.col("t.pos").alias("pos"), F.col("t.threshold").alias("threshold")).agg(F.count_if(F.col("score") >= F.col("t.threshold")).alias("n"))


def warnings(long: DataFrame, last: float = 0.7, few: int = 30, narrow: float = 0.01) -> DataFrame:
    """low_variance overrides few_samples, which looks at the last threshold's count."""
    by = long.groupBy("axis").agg(F.var_pop("score").alias("v"), F.count_if(F.col("score") >= last).alias("c"))
    return by.select("axis", F.when(F.col("v") < narrow, "low_variance").when(F.col("c") < few, "few_samples").otherwise("").alias("warning"))


def top_n(long: DataFrame, n: int, order: str) -> DataFrame:
    """rank within the axis by score downwards, ties by order; the first n."""
    w = Window.partitionBy("axis").orderBy(F.desc("score"), order)
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def main_axis(labels: str | None = None) -> Column:
    """Name of the axis of the highest score, the earliest of equal ones."""
    best = F.array_max(F.array(*[F.struct(axis_value(a, labels).alias("s"), F.lit(-i).alias("i")) for i, a in enumerate(AXES)]))
    return F.element_at(F.array(*[F.lit(a) for a in AXES]), 1 - best["i"])


def percent(c: Column) -> Column:
    """Whole percent, half to even."""
    return F.bround(c * 100, 0).cast("bigint")


def sheet(df: DataFrame, n: int, order: str, keep: list[str]) -> DataFrame:
    """Top n of every axis with the labels and percentages of an exported sheet."""
    base = df.select(order, *keep, main_axis().alias("top"), *[percent(axis_value(a)).alias(f"pct_{a}") for a in AXES], *[axis_value(a).alias(f"v_{a}") for a in AXES])
    parts = F.array(*[F.struct(F.lit(i).alias("axis_pos"), F.lit(a).alias("axis"), F.col(f"v_{a}").alias("score")) for i, a in enumerate(AXES)])
    # rank slim rows first; texts join only what is kept
    long = base.select(order, F.explode(parts).alias("s")).select(order, "s.*")
    best = top_n(long, n, order)
    out = best.join(base.drop(*[f"v_{a}" for a in AXES]), order)
    label = lambda c: F.concat(F.lit("["), F.upper(c), F.lit("]"))
    return out.select(label(F.col("axis")).alias("ideology"), "rank", percent(F.col("score")).alias("main_score"), label(F.col("top")).alias("top_overall"), order, *keep, *[f"pct_{a}" for a in AXES])


def summary(long: DataFrame, n: int, order: str) -> DataFrame:
    """Per axis: counts from 0.5 and 0.7 on; mean, least and greatest of the top n in percent, one decimal, 0 without rows."""
    top = top_n(long, n, order).groupBy("axis").agg(*[F.bround(f("score") * 100, 1).alias(k) for k, f in (("mean_top", F.avg), ("min_top", F.min), ("max_top", F.max))])
    all_ = long.groupBy("axis").agg(F.count_if(F.col("score") >= 0.5).alias("from_50"), F.count_if(F.col("score") >= 0.7).alias("from_70"))
    return all_.join(top, "axis", "left").select(F.initcap("axis").alias("ideology"), "from_50", "from_70", *[F.coalesce(k, F.lit(0.0)).alias(k) for k in ("mean_top", "min_top", "max_top")])
