"""Train, validation and test splits of fixed sizes, and windows over token arrays."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribra.operators.prefix import exclusive_prefix


def split_sizes(n: int, val: float = 0.15, test: float = 0.15) -> tuple[int, int, int]:
    """(train, val, test): the fractions cut to whole rows, the rest to train."""
    v, t = int(n * val), int(n * test)
    return n - v - t, v, t


def manifest(n: int, seed: int = 42, val: float = 0.15, test: float = 0.15) -> dict[str, list[int]]:
    """Positions by split as a seeded shuffle on the driver gives them, for data sets that fit a driver; lists sorted."""
    ids = list(range(n))
    random.Random(seed).shuffle(ids)
    a, v, _ = split_sizes(n, val, test)
    return {"train": sorted(ids[:a]), "val": sorted(ids[a : a + v]), "test": sorted(ids[a + v :])}


def assign_splits(df: DataFrame, key: str, seed: int = 42, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """Adds split: exact sizes, by the order of md5(seed, key). The rank is a two-level running count, not one task's window."""
    n = df.count()
    a, v, _ = split_sizes(n, val, test)
    df = df.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    bits = min(30, max(8, (n // 50_000).bit_length()))  # buckets of some 50,000 rows at any size
    bucket = F.shiftright(F.conv(F.substring("__h", 1, 8), 16, 10).cast("long"), 32 - bits)
    df = exclusive_prefix(df.withColumn("__one", F.lit(1)), ["__one"], bucket, ["__h", key], F.lit(1), "__rank")
    return df.withColumn("split", F.when(F.col("__rank") < a, "train").when(F.col("__rank") < a + v, "val").otherwise("test")).drop("__h", "__one", "__rank")


def with_ordinal(df: DataFrame, key: str, name: str = "ord", start: int = 0) -> DataFrame:
    """Adds each row's place by a whole-number key without repeats, counted from start: what a cursor or an index over rows keeps.

    Places are counted by ranges of the key, so no task gets the whole table. Null keys have no place and no row.
    """
    df = df.where(F.col(key).isNotNull()).withColumn("__one", F.lit(1))
    df = exclusive_prefix(df, ["__one"], F.expr(f"floor(`{key}` / 50000)"), [key], F.lit(1), "__place")
    return df.withColumn(name, (F.col("__place") + start).cast("long")).drop("__one", "__place")


class Tokenizer(Protocol):
    """Ids of a text; one instance per task."""

    def __call__(self, text: str) -> list[int]: ...


class WordLengths:
    """A local stand-in for a tokenizer: a word's id is its length."""

    def __call__(self, text: str) -> list[int]:
        return [len(w) for w in text.split()]


def tokenize(df: DataFrame, text: str, make: Callable[[], Tokenizer], name: str = "tokens") -> DataFrame:
    """Adds the ids of a text column, null for null, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = make()
        for b in batches:
            ids = pa.array([None if t is None else tok(t) for t in b.column(text).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, name])

    kept = [f"`{c}` {t}" for c, t in df.dtypes if c != name]
    return df.drop(name).mapInArrow(run, ", ".join([*kept, f"`{name}` array<int>"]))


def window_count(length: Column, content: int, stride: int) -> Column:
    """Windows over length tokens; none begins behind the last token."""
    return F.when(length <= content, 1).otherwise(F.least(F.ceil((length - content) / stride) + 1, F.ceil(length / stride))).cast("int")


def windows(df: DataFrame, tokens: str, size: int = 512, stride: int = 384, specials: int = 2) -> DataFrame:
    """Explodes an array into overlapping windows of size - specials: adds chunk_idx and chunk, drops tokens."""
    content = size - specials
    if content <= 0 or stride <= 0:
        raise ValueError("size must exceed the special tokens and stride must be positive")
    k = window_count(F.size(tokens), content, stride)
    parts = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.slice(F.col(tokens), i * stride + 1, content))
    return df.select(*[c for c in df.columns if c != tokens], F.posexplode(parts).alias("chunk_idx", "chunk"))


def first_window(tokens: Column, size: int = 512, specials: int = 2) -> Column:
    return F.slice(tokens, 1, size - specials)


def wrap(chunk: Column, size: int, cls: int = 101, sep: int = 102, pad: int = 0) -> tuple[Column, Column]:
    """(ids, mask): special tokens around, padding behind."""
    ids = F.concat(F.array(F.lit(cls)), chunk, F.array(F.lit(sep)))
    gap = F.greatest(F.lit(size) - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(pad), gap)), F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), gap))


STRATEGIES = ("truncate", "sliding_window")


def chunks(df: DataFrame, tokens: str, strategy: str = "truncate", size: int = 512, stride: int = 384) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    if strategy == "sliding_window":
        return windows(df, tokens, size, stride)
    return df.withColumn("chunk_idx", F.lit(0)).withColumn("chunk", first_window(F.col(tokens), size)).drop(tokens)
