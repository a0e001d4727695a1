"""Model responses that hold JSON: unwrapping, validation, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribra.axes import AXES
from cribra.functions.text import barrier, strip_space

FENCE = "```"


def unwrap(c: Column) -> Column:
    """The text in the first json fence, else in the first bare fence, else as it is; stripped."""
    t = strip_space(c)
    part = lambda x, by, n: F.split_part(x, F.lit(by), F.lit(n))
    t = F.when(F.contains(t, F.lit(FENCE + "json")), part(part(t, FENCE + "json", 2), FENCE, 1)).when(F.contains(t, F.lit(FENCE)), part(t, FENCE, 2)).otherwise(t)
    return strip_space(t)


def _one(c: Column) -> Column:
    """The variant of a text that is exactly one JSON value, in an array; null else."""
    v = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), v)


def _kind(v: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$[0].{key}", "variant"))


def _is_number(v: Column, key: str) -> Column:
    """Booleans count as numbers."""
    return F.coalesce(_kind(v, key).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)"), F.lit(False))


def _number(v: Column, key: str) -> Column:
    return F.when(_kind(v, key) == "BOOLEAN", F.try_variant_get(v, f"$[0].{key}", "boolean").cast("double")).otherwise(F.try_variant_get(v, f"$[0].{key}", "double"))


def with_parsed(df: DataFrame, response: str, parse, name: str = "p") -> DataFrame:
    """Adds parse (judge or verdict) of a response column. The JSON is parsed once, behind a barrier."""
    df = barrier(df, "__v", _one(unwrap(F.col(response))))
    return barrier(df, name, parse(F.col("__v"))).drop("__v")


def judge(v: Column) -> Column:
    """Struct (is_political int, the axes as doubles in [0, 100]); null unless all keys are there and all scores numbers."""
    political = F.when(_is_number(v, "is_political"), _number(v, "is_political").cast("int")).otherwise(F.try_variant_get(v, "$[0].is_political", "string").try_cast("int"))
    ok = political.isNotNull()
    for a in AXES:
        ok = ok & _is_number(v, a)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    return F.when(ok, F.struct(political.alias("is_political"), *[clamp(_number(v, a)).alias(a) for a in AXES]))


def normalise(parsed: Column) -> Column:
    """Scores to [0, 1] with four decimals, half to even."""
    return F.when(parsed.isNotNull(), F.struct(parsed["is_political"].alias("is_political"), *[F.bround(parsed[a] / 100, 4).alias(a) for a in AXES]))


def verdict(v: Column) -> Column:
    """Struct (is_article boolean, category, reason); null unless is_article and category are there.

    is_article goes by truth: a number other than 0 and any text but the empty one count as true.
    """
    kind = _kind(v, "is_article")
    get = lambda k: F.try_variant_get(v, f"$[0].{k}", "string")
    truth = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$[0].is_article", "boolean")).when(kind == "STRING", get("is_article") != "").when(kind == "VOID", F.lit(False)).otherwise(F.coalesce(F.try_variant_get(v, "$[0].is_article", "double") != 0, F.lit(True)))
    return F.when(kind.isNotNull() & _kind(v, "category").isNotNull(), F.struct(truth.alias("is_article"), get("category").alias("category"), get("reason").alias("reason")))
