"""Whole jobs: scrape the sources, train and measure a run, compare the runs of a folder."""

from __future__ import annotations

import json
import time
from datetime import datetime, timezone

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cribra.axes import AXES
from cribra.functions import urls
from cribra.operators import discovery, evaluation, ledger
from cribra.plans import benchmark, models, report
from cribra.sources import jsonl
from cribra.tables import materialize


def utc_now() -> str:
    """The instant in UTC as ISO text."""
    return datetime.now(timezone.utc).isoformat()


def robots_allowed(df: DataFrame, rules: DataFrame) -> DataFrame:
    """df(url, ...) without the urls that their host's rules(host, disallow, allow) forbid; hosts without rules forbid nothing."""
    path = F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    r = rules.select(F.col("host").alias("__host"), F.col("disallow").alias("__no"), F.col("allow").alias("__yes"))
    j = df.withColumn("__host", urls.url_host(F.col("url"))).join(r, "__host", "left")
    return j.where(urls.robots_allows(F.when(path == "", "/").otherwise(path), F.col("__no"), F.coalesce("__yes", F.array().cast("array<string>")))).select(*df.columns)


def scrape(candidates: DataFrame, known: DataFrame, rules: DataFrame, extracted: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """candidates(source, url), known(url, content_hash), rules(host, disallow, allow), extracted(url, content_hash) -> (source, pos, url, content_hash).

    What a loop over the sources, by name, accepts: of each source the first 2 * most candidates of a seeded shuffle are
    tried in order until `most` are accepted; addresses of the ledger, forbidden ones, those that gave no article and
    contents accepted before are passed over. Candidates behind a source's last one leave nothing in the ledger, so
    acceptance is settled again without them until there are none: once or twice, at most once for every source.
    """
    tried = discovery.shuffle_limit(candidates.where("url <> ''").select("source", "url").distinct(), ["source"], "url", seed, 2 * most)
    tried = ledger.not_in_ledger(tried, known, "url")
    tried = robots_allowed(tried, rules).join(ledger.first_wins(extracted.where("content_hash IS NOT NULL"), ["url"], ["content_hash"]).select("url", "content_hash"), "url")
    rows = materialize(tried.select("source", "pos", "url", "content_hash"), "tried")
    while True:
        done = materialize(ledger.accept(rows, known, ["source", "pos"]), "accepted")
        seen = ledger.accept_limit(done, F.lit(True), ["source"], ["source", "pos"], most)
        behind = materialize(done.join(seen, ["source", "pos"], "left_anti"), "behind")
        if behind.isEmpty():
            return done
        # each source that went too far ends at its last accepted candidate
        last = seen.groupBy("source").agg(F.max("pos").alias("__last")).join(behind.select("source").distinct(), "source")
        rows = materialize(rows.join(last, "source", "left").where(F.col("__last").isNull() | (F.col("pos") <= F.col("__last"))).select(*rows.columns), "tried")


def train(df: DataFrame, directory: str, encoder: str, seed: int, regs: tuple[float, ...] = (1.0, 0.3, 0.1, 0.03, 0.01), patience: int = 3, smoke: bool = False) -> dict:
    """df(features, split, is_political, axes...) -> the run's metrics, also written as <directory>/<encoder>__seed<seed>/metrics.json.

    One setting after another is fitted on train and measured on val; after `patience` settings without a better loss the
    search stops, and the best model is kept beside the metrics. A politicity head tells political rows apart, the axes
    are measured on political rows alone. smoke tries one setting on few rows, to see that a run ends.
    """
    spark, began = df.sparkSession, time.time()
    df = materialize(df.limit(200) if smoke else df, "training")
    political = df.where("is_political = 1")
    best, waited = None, 0
    for reg in regs[:1] if smoke else regs:
        m = models.fit(political.where("split = 'train'"), reg=reg)
        loss = evaluation.masked_loss(models.predict(m, political.where("split = 'val'")), list(AXES), [f"p_{a}" for a in AXES], F.expr(" AND ".join(f"{a} IS NOT NULL" for a in AXES))).first()["loss"]
        if best is None or loss < best[0]:
            best, waited = (loss, reg, m), 0
        else:
            waited += 1
            if waited >= patience:
                break
    loss, reg, m = best
    path = f"{directory.rstrip('/')}/{encoder}__seed{seed}"
    models.save(m, f"{path}/best")
    test = {}
    for part in ("val", "test"):
        rows = evaluation.regression_metrics(axis_pairs(models.predict(m, political.where(F.col("split") == part))), ["axis"], "y", "p").collect()
        for r in rows:
            test |= {f"{part}/{k}_{r['axis']}": r[k] for k in ("mse", "r2") if r[k] is not None}
    labels = df.where("split = 'train' AND is_political IS NOT NULL").select("is_political").distinct().count()
    if labels == 2:
        head = LogisticRegression(labelCol="is_political", regParam=reg, maxIter=30).fit(df.where("split = 'train' AND is_political IS NOT NULL"))
        right = head.transform(df.where("split = 'test' AND is_political IS NOT NULL")).agg(F.avg((F.col("prediction") == F.col("is_political")).cast("double"))).first()[0]
        test |= {"test/politicity_accuracy": right} if right is not None else {}
    out = {"encoder_alias": encoder, "model_name": f"linear-{reg:g}", "seed": seed, "git_commit": benchmark.git_short_hash(), "precision_used": "fp64", "train_duration_seconds": round(time.time() - began, 3), "best_checkpoint": f"{path}/best", "best_val_loss": loss, "test_metrics": test}
    spark.createDataFrame([(json.dumps(out, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metrics.json")
    return out


def axis_pairs(df: DataFrame) -> DataFrame:
    """(axis, y, p) from a column for each axis and p_<axis>."""
    pair = lambda a: F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("y"), F.col(f"p_{a}").alias("p"))
    return df.select(F.explode(F.array(*map(pair, AXES))).alias("x")).select("x.*")


def metrics_rows(runs: DataFrame) -> DataFrame:
    """Runs of jsonl.read_runs -> (encoder, seed, axis, r2, mse), the test value of each, else the validation value."""
    m = runs.select("encoder", F.col("run_seed").alias("seed"), "test_metrics", F.explode(F.array(*map(F.lit, AXES))).alias("axis"))
    value = lambda k: evaluation.metric(F.col("test_metrics"), k, F.col("axis"))
    return m.select("encoder", "seed", "axis", value("r2").alias("r2"), value("mse").alias("mse"))


def compare(spark: SparkSession, directory: str, out: str) -> DataFrame:
    """Compares all runs of a folder: writes <out>/metrics.csv (none for no values) and <out>/report.md, gives the ranked axes."""
    runs = materialize(jsonl.read_runs(spark, directory), "runs")
    rows = materialize(metrics_rows(runs), "run-metrics")
    summary = materialize(evaluation.axis_summary(rows), "axis-summary")
    jsonl.write_metrics_csv(rows, f"{out}/metrics.csv")
    per = evaluation.encoder_summary(runs.select("encoder", F.col("run_seed").alias("seed"), "model_name", F.col("train_duration_seconds").alias("train_seconds"), F.col("best_val_loss").alias("val_loss"), "git_commit"))
    spark.createDataFrame([(report.markdown(summary, per),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/report.md")
    return evaluation.ranks(summary)


def vector(columns: tuple[str, ...] = AXES) -> Column:
    """The axes' scores as one array in their order, 0 where one is missing."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])


def named(names: Column, values: Column) -> Column:
    """A map of names to values as far as both go."""
    n = F.least(F.size(names), F.size(values))
    return F.map_from_arrays(F.slice(names, F.lit(1), n), F.slice(values, F.lit(1), n))
