"""Split manifests: one JSON object with the positions of each split."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def dump(manifest: dict[str, list[int]], source_file: str, seed: int, val: float, test: float) -> str:
    return json.dumps({"source_file": source_file, "total_samples": sum(map(len, manifest.values())), "seed": seed, "val_split": val, "test_split": test, **manifest}, indent=2)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(idx, split)."""
    schema = "source_file string, total_samples long, seed int, val_split double, test_split double, " + ", ".join(f"{s} array<long>" for s in SPLITS)
    m = spark.read.schema(schema).option("multiLine", True).json(path)
    return m.select(F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("ids")) for s in SPLITS])).alias("p")).select(F.explode("p.ids").alias("idx"), "p.split")
