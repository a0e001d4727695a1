"""JSON-lines datasets: explicit schemas, counts, append and overwrite, dry runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cribra.axes import AXES
from cribra.functions.text import strip_space

_S = T.StringType()
RAW_ARTICLE = T.StructType([T.StructField(n, T.ArrayType(_S) if n == "authors" else _S) for n in ("text", "title", "authors", "source", "category", "url", "date", "scraped_at")])
LABELED_ARTICLE = T.StructType([*[T.StructField(n, _S) for n in ("text", "title", "source", "category", "url", "date")], T.StructField("is_political", T.IntegerType()), *[T.StructField(a, T.DoubleType()) for a in AXES], T.StructField("labels", T.MapType(_S, T.DoubleType()))])
RUN_METRICS = T.StructType([T.StructField("encoder_alias", _S), T.StructField("model_name", _S), T.StructField("seed", T.IntegerType()), T.StructField("git_commit", _S), T.StructField("precision_used", _S), T.StructField("train_duration_seconds", T.DoubleType()), T.StructField("best_checkpoint", _S), T.StructField("best_val_loss", T.DoubleType()), T.StructField("test_metrics", T.MapType(_S, T.DoubleType()))])


def read(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Blank lines give no row. strict: a line that isn't JSON fails the job instead of giving nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_labeled(spark: SparkSession, path: str) -> DataFrame:
    """Political rows of a labelled dataset, strictly read."""
    return read(spark, path, LABELED_ARTICLE, strict=True).where("is_political = 1")


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, as the cleaned dataset before the unfiltered one."""
    fs = spark._jvm.org.apache.hadoop.fs
    for p in paths:
        path = fs.Path(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return p
    raise FileNotFoundError(", ".join(paths))


def line_counts(spark: SparkSession, path: str) -> tuple[int, int]:
    """(physical lines, lines that aren't blank)."""
    r = spark.read.text(path).agg(F.count("*").alias("a"), F.count_if(strip_space(F.col("value")) != "").alias("b")).first()
    return r["a"], r["b"]


def write(df: DataFrame, path: str, force: bool = False, dry: bool = False) -> DataFrame:
    """Appends, overwrites under force, writes nothing in a dry run; text stays unescaped UTF-8."""
    if not dry:
        df.write.mode("overwrite" if force else "append").option("ignoreNullFields", "false").json(path)
    return df


def read_runs(spark: SparkSession, directory: str) -> DataFrame:
    """metrics.json of every run directory, with run, encoder and seed from its name, else from the file."""
    from cribra.operators.evaluation import parse_run_key

    df = spark.read.schema(RUN_METRICS).option("multiLine", True).json(f"{directory.rstrip('/')}/*/metrics.json")
    # the file, or a folder of that name as Spark writes it
    df = df.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/metrics\.json(?:/[^/]*)?$", 1))
    enc, seed = parse_run_key(F.col("run"), F.col("encoder_alias"), F.col("seed"))
    return df.withColumns({"encoder": enc, "run_seed": seed})


def write_metrics_csv(long: DataFrame, path: str) -> bool:
    """Long metrics with a header; no file for no rows."""
    if long.isEmpty():
        return False
    long.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # runs x axes rows
    return True
