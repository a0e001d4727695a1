"""Multi-axis regressors: local linear models in place of a fine-tuned encoder, behind the same steps."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribra.axes import AXES
from cribra.operators.evaluation import sigmoid


def features(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform(embedding, lambda x: x.cast("double"))))


def logit(c: Column) -> Column:
    p = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), c))
    return F.log(p / (1 - p))


def fit(df: DataFrame, axes=AXES, reg: float = 0.01) -> dict[str, object]:
    """One linear model per axis on the logit of its score, rows without it left out. df(features, axes...)."""
    df = df.select("features", *axes).persist()
    try:
        models = {}
        for a in axes:
            d = df.where(F.col(a).isNotNull()).withColumn("__y", logit(F.col(a)))
            models[a] = LinearRegression(featuresCol="features", labelCol="__y", predictionCol=f"__{a}", regParam=reg, maxIter=50).fit(d)
        return models
    finally:
        df.unpersist()


def predict(models: dict[str, object], df: DataFrame) -> DataFrame:
    """Adds p_<axis> in [0, 1] and axes, a map of scores 0-100 with two decimals."""
    for a, m in models.items():
        df = m.transform(df).withColumn(f"p_{a}", sigmoid(F.col(f"__{a}"))).drop(f"__{a}")
    return df.withColumn("axes", F.create_map(*[x for a in models for x in (F.lit(a), F.bround(F.col(f"p_{a}") * 100, 2))]))


def save(models: dict[str, object], path: str) -> None:
    PipelineModel(list(models.values())).write().overwrite().save(path)


def load(path: str, axes=AXES) -> dict[str, object]:
    return dict(zip(axes, PipelineModel.load(path).stages))


