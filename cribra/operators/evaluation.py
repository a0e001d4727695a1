"""Errors of multi-output regressors and comparison of many runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cribra.axes import AXES


def regression_metrics(df: DataFrame, group: list[str], truth: str, predicted: str) -> DataFrame:
    """n, mse and r2 by group, rows with a null left out; r2 is null where the truth doesn't vary."""
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    d = df.where(y.isNotNull() & p.isNotNull())
    s = d.groupBy(*group).agg(F.count("*").alias("n"), F.sum((y - p) * (y - p)).alias("__e"), F.sum(y * y).alias("__yy"), F.sum(y).alias("__y"))
    total = F.col("__yy") - F.col("__y") * F.col("__y") / F.col("n")
    return s.select(*group, "n", F.round(F.col("__e") / F.col("n"), 6).alias("mse"), F.round(F.when(total > 1e-12, 1 - F.col("__e") / total), 6).alias("r2"))


def masked_loss(df: DataFrame, truth: list[str], predicted: list[str], mask: Column) -> DataFrame:
    """Mean squared error over all outputs of the rows under the mask; 0 when it is empty."""
    e = sum((F.pow(F.col(t) - F.col(p), F.lit(2)) for t, p in zip(truth, predicted)), F.lit(0.0))
    return df.where(mask).agg(F.round(F.coalesce(F.sum(e) / (F.count("*") * len(truth)), F.lit(0.0)), 6).alias("loss"))


def softmax2(l0: Column, l1: Column) -> tuple[Column, Column]:
    """(is the second class, strictly more likely; its probability with four decimals)."""
    p1 = 1 / (1 + F.exp(l0 - l1))
    return l1 > l0, F.round(p1, 4)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def activation(kind: str, x: Column) -> Column:
    """A head's output: sigmoid, relu or linear."""
    return {"sigmoid": sigmoid(x), "relu": F.greatest(x, F.lit(0.0)), "linear": x}[kind]


def polygon(c: Column) -> Column:
    """An array with its first element at the end again."""
    return F.concat(c, F.slice(c, 1, 1))


def angles(n: int) -> list[float]:
    return [2 * math.pi * i / n for i in range(n)]


def run_key(encoder: Column, seed: Column) -> Column:
    return F.concat(encoder, F.lit("__seed"), seed.cast("string"))


def parse_run_key(key: Column, alias: Column | None = None, seed: Column | None = None) -> tuple[Column, Column]:
    """(encoder, seed) of a run's name; where it has another form, the given alias or the name, and the given seed or 0."""
    pattern = r"^(.+?)__seed(\d+)$"
    ok = key.rlike(pattern)
    return F.when(ok, F.regexp_extract(key, pattern, 1)).otherwise(F.coalesce(alias, key) if alias is not None else key), F.when(ok, F.regexp_extract(key, pattern, 2).try_cast("int")).otherwise(F.coalesce(seed, F.lit(0)) if seed is not None else F.lit(0))


def metric(metrics: Column, kind: str, axis: Column) -> Column:
    """The test value, else the validation value, else null."""
    return F.coalesce(*[F.try_element_at(metrics, F.concat(F.lit(f"{p}/{kind}_"), axis)) for p in ("test", "val")])


def mean_std(c: Column) -> tuple[Column, Column]:
    """Mean and sample deviation, 0 for one value."""
    return F.avg(c), F.coalesce(F.stddev_samp(c), F.lit(0.0))


def encoder_summary(runs: DataFrame) -> DataFrame:
    """runs(encoder, seed, model_name, train_seconds, val_loss, git_commit) -> one row per encoder."""
    m, s = mean_std(F.coalesce("train_seconds", F.lit(0.0)) / 60)
    lm, ls = mean_std(F.col("val_loss"))
    return runs.groupBy("encoder").agg(
        F.count("*").alias("n_seeds"), F.array_join(F.transform(F.sort_array(F.collect_list("seed")), lambda x: x.cast("string")), ",").alias("seeds"),
        F.round(m, 6).alias("minutes_mean"), F.round(s, 6).alias("minutes_std"), F.round(lm, 6).alias("loss_mean"), F.round(ls, 6).alias("loss_std"),
        F.min_by("model_name", "seed").alias("model_name"), F.min_by("git_commit", "seed").alias("git_commit"),
    )


def axis_summary(values: DataFrame) -> DataFrame:
    """values(encoder, seed, axis, r2, mse) -> means and deviations by encoder and axis, nulls skipped."""
    r, rs = mean_std(F.col("r2"))
    m, ms = mean_std(F.col("mse"))
    return values.groupBy("encoder", "axis").agg(F.round(r, 6).alias("r2_mean"), F.round(F.when(F.count("r2") > 0, rs).otherwise(0.0), 6).alias("r2_std"), F.round(m, 6).alias("mse_mean"), F.round(F.when(F.count("mse") > 0, ms).otherwise(0.0), 6).alias("mse_std"))


def _no_number(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c)


def ranks(summary: DataFrame) -> DataFrame:
    """Adds rank by r2 within each axis, ties by name; NaN and null last."""
    w = Window.partitionBy("axis").orderBy(_no_number("r2_mean"), F.desc("r2_mean"), "encoder")
    return summary.withColumn("rank", F.row_number().over(w))


def winners(summary: DataFrame) -> DataFrame:
    """Best encoder by axis: greatest r2 and least mse, ties by name; NaN and null win only where nothing else is."""
    r = Window.partitionBy("axis").orderBy(_no_number("r2_mean"), F.desc("r2_mean"), "encoder")
    m = Window.partitionBy("axis").orderBy(_no_number("mse_mean"), F.asc("mse_mean"), "encoder")
    d = summary.select("axis", F.first("encoder").over(r).alias("best_r2"), F.first("encoder").over(m).alias("best_mse"))
    return d.distinct()


def mean_ranks(ranked: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Wins, mean rank and the ranks in the order of axes, as a text list; macro averages skip NaN."""
    place = F.array_position(F.array(*map(F.lit, axes)), F.col("axis"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(place, "rank"))), lambda x: x["rank"].cast("string"))
    ok = lambda c: F.when(~F.isnan(c), F.col(c))
    return ranked.groupBy("encoder").agg(F.count_if(F.col("rank") == 1).alias("wins"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.array_join(listed, ",").alias("ranks"), F.round(F.avg(ok("r2_mean")), 6).alias("macro_r2"), F.round(F.avg(ok("mse_mean")), 6).alias("macro_mse"))


def format_mean_std(mean: Column, std: Column, decimals: int = 3, show: Column | None = None) -> Column:
    f = f"%.{decimals}f"
    hide = (std == 0) | (~show if show is not None else F.lit(False))
    return F.when(hide, F.format_string(f, mean)).otherwise(F.format_string(f"{f} ± {f}", mean, std))


def chart_limits(df: DataFrame, column: str) -> DataFrame:
    """Least and greatest finite value, with 0 and 1 as bounds and a tenth of the span around."""
    v = df.where(F.col(column).isNotNull() & ~F.isnan(column)).agg(F.min(column).alias("a"), F.max(column).alias("b"))
    lo, hi = F.least(F.coalesce("a", F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce("b", F.lit(1.0)), F.lit(1.0))
    return v.select(F.round(lo - (hi - lo) * 0.1, 6).alias("low"), F.round(hi + (hi - lo) * 0.1, 6).alias("high"))
