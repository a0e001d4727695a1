"""Text expressions: cleaning, cutting, author fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribra.functions.patterns import AFTER_AUTHORS, STEPS, spell

EDGE_SPACE = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def strip_space(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def apply_steps(c: Column, steps=STEPS) -> Column:
    for _, flags, template, repl, _once in steps:  # a pattern that applies once is anchored at the beginning
        c = F.regexp_replace(c, spell(template, flags, "java"), repl)
    return c


def without_author_lines(text: Column, authors: Column) -> Column:
    """Drops the lines that, stripped and in lower case, equal an author; blank lines stay. Null authors drop none."""
    names = F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.lower(strip_space(a))), lambda a: a != "")
    kept = F.filter(F.split(text, "\n"), lambda line: (F.lower(strip_space(line)) == "") | ~F.coalesce(F.array_contains(names, F.lower(strip_space(line))), F.lit(False)))
    return F.when(F.size(names) > 0, F.array_join(kept, "\n")).otherwise(text)


def clean_article(text: Column, authors: Column | None = None) -> Column:
    """The whole cleaning chain C0-C16. Null gives null. Use it behind barrier() when more than one expression needs it."""
    c = apply_steps(text)
    if authors is not None:
        c = without_author_lines(c, authors)
    return strip_space(apply_steps(c, AFTER_AUTHORS))


def barrier(df: DataFrame, name: str, c: Column) -> DataFrame:
    """Adds a costly column that later filters and projections don't compute again: it comes out of a generator."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def prefix(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def ellipsis(c: Column, most: int = 90) -> Column:
    """Texts above most code points end in three dots at that length."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def split_authors(c: Column) -> Column:
    """Names between semicolons, stripped, without empty ones; null gives an empty array."""
    return F.coalesce(F.filter(F.transform(F.split(c, ";"), strip_space), lambda a: a != ""), F.array().cast("array<string>"))
