"""Running totals within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Neighbouring buckets whose sums are one window.
FAN = 4096


def exclusive_prefix(df: DataFrame, group: list[str], bucket: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds name: the sum of value over the rows of the same group that come before in (bucket, order).

    bucket, a whole number, must not fall along the order. A window over a whole group would be one task however large the
    group is; here windows run within (group, bucket), over the sums of FAN buckets, and over the sums of those, so choose
    buckets of bounded size. Rows keep their columns; null values count as 0; ties in order must be broken by the caller.
    """
    keys = [*group, "__bucket"]
    df = df.withColumns({"__bucket": bucket, "__value": F.coalesce(value, F.lit(0))})
    sums = df.groupBy(*keys).agg(F.sum("__value").alias("__sum")).withColumn("__run", F.expr(f"__bucket div {FAN}"))
    before = lambda c, parts, at: F.coalesce(F.sum(c).over(Window.partitionBy(*parts).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sums.groupBy(*group, "__run").agg(F.sum("__sum").alias("__of")).withColumn("__far", before("__of", group, ["__run"])).drop("__of")
    sums = sums.withColumn("__near", before("__sum", [*group, "__run"], ["__bucket"])).join(runs, [*group, "__run"])
    sums = sums.select(*keys, (F.col("__near") + F.col("__far")).alias("__base"))
    df = df.withColumn("__in", before("__value", keys, order))
    return df.join(sums, keys).withColumn(name, F.col("__base") + F.col("__in")).drop("__bucket", "__value", "__base", "__in")
