"""Per-document text statistics and a learned rule list that tells prose from lists, tables and junk (problem 3)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cribra.functions.text import barrier
from cribra.llm.quality_seeds import labelled
from cribra.llm.rulelist import induce, to_case

#: Words that make up much of any running text in the corpus' languages.
COMMON = tuple("de la el que en y a los del las se por con un una para es al lo como más mas no su sus o pero si ya sobre este esta entre cuando muy sin desde hasta qué donde porque fue ha son e ni the of and to in is that for on with as was by o do da em um uma não os no na dos das à ao pelo".split())
#: Labelled documents for the induction: the bound of the sample.
LABELLED = 1200
STATS = ("words", "lines", "mean_word_len", "symbol_ratio", "end_punct_share", "common_share", "words_per_line", "digit_share", "distinct_share")


def with_stats(df: DataFrame, text: str = "body") -> DataFrame:
    """Adds the columns STATS, all native expressions.

    words: runs of letters and digits. mean_word_len: letters and digits per word. symbol_ratio: share of the
    non-blank characters that are neither. end_punct_share: share of the non-blank lines whose last sign, closing quotes
    and brackets aside, ends a sentence. common_share: share of words in COMMON. digit_share: share of letters and
    digits that are digits. distinct_share: distinct words per word. Null and empty text give 0 everywhere. The named columns are replaced if df has them.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({
        "__toks": F.filter(F.split(F.lower(t), r"[^\p{L}\p{M}\p{N}]+"), lambda x: x != ""),
        "__lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"\S")),
        "__solid": F.length(F.regexp_replace(t, r"\s+", "")),
    })
    df = df.withColumns({
        "words": F.size("__toks"),
        "lines": F.size("__lines"),
        "__alnum": F.length(F.array_join("__toks", "")),
        "__digits": F.length(F.regexp_replace(F.array_join("__toks", ""), r"\D+", "")),
        "__ends": F.size(F.filter("__lines", lambda x: x.rlike(r"(?s)^.*[.!?…:][\s»”\"')\]]*$"))),  # looks from the line's end
        "__distinct": F.size(F.array_distinct(F.transform("__toks", lambda x: F.xxhash64(x)))),
        "__common": F.size(F.filter("__toks", lambda x: x.isin(*COMMON))),
    })
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    df = df.withColumns({
        "mean_word_len": ratio("__alnum", "words"),
        "symbol_ratio": F.when(F.col("__solid") > 0, 1 - F.least(F.col("__alnum"), F.col("__solid")) / F.col("__solid")).otherwise(F.lit(0.0)),
        "end_punct_share": ratio("__ends", "lines"),
        "common_share": ratio("__common", "words"),
        "words_per_line": ratio("words", "lines"),
        "digit_share": ratio("__digits", "__alnum"),
        "distinct_share": ratio("__distinct", "words"),
    })
    return df.drop("__toks", "__lines", "__solid", "__alnum", "__digits", "__ends", "__common", "__distinct")


@lru_cache(maxsize=4)
def _case(n: int) -> str:
    spark = SparkSession.getActiveSession()
    docs = labelled(n)
    rows = with_stats(spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(docs)], "i int, body string, y int").coalesce(2)).select("y", *STATS).collect()
    use = [c for c in STATS if c not in ("words", "lines", "digit_share", "mean_word_len")]  # prose may be short, long or full of figures
    x = {c: np.array([float(r[c]) for r in rows]) for c in use}
    return to_case(induce(x, np.array([r["y"] == 1 for r in rows])))


def no_prose_rule(n: int = LABELLED) -> Column:
    """Number of the first induced rule that calls a row of with_stats no prose, 0 for prose."""
    return F.expr(_case(n))


def flag_no_prose(df: DataFrame, text: str = "body") -> DataFrame:
    """Adds STATS, rule (see no_prose_rule) and no_prose. A text without a word is no prose."""
    # the barrier keeps a filter on no_prose from taking the tokenisation with it, once for every use of a statistic
    df = barrier(with_stats(df, text), "__judged", F.struct(no_prose_rule().alias("rule"), (F.col("words") == 0).alias("wordless")))
    return df.withColumns({"rule": F.col("__judged.rule"), "no_prose": (F.col("__judged.rule") > 0) | F.col("__judged.wordless")}).drop("__judged")
