"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cribra.functions.patterns import NOISE_SECTIONS


def url_section(url: Column) -> Column:
    """First path segment in lower case, root where there is none. A bare word counts as a path, as does a URL with blanks."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*:", ""), r"[?#][\s\S]*$", "")
    path = F.regexp_replace(path, r"^//[^/]*", "")
    first = F.lower(F.regexp_extract(path, r"^/*([^/]*)", 1))
    return F.when(url.isNull() | (first == ""), "root").otherwise(first)


def is_noise(url: Column, sections=NOISE_SECTIONS) -> Column:
    return url_section(url).isin(*sections)


def passes_filters(url: Column, filters: Column) -> Column:
    """Some filter stands in the url, whatever their case; no filters let everything pass.

    The url goes through the loop as its state, as a lambda may not name a column here: in a session's first query the
    optimizer takes a column of id 1 for the lambda's own variable, and pushes the filter to the side of a join without it.
    """
    step = lambda a, f: F.struct(a["u"].alias("u"), (a["ok"] | F.coalesce(F.contains(a["u"], F.lower(f)), F.lit(False))).alias("ok"))
    some = F.aggregate(filters, F.struct(F.lower(url).alias("u"), F.lit(False).alias("ok")), step, lambda a: a["ok"])
    return (F.coalesce(F.size(filters), F.lit(0)) <= 0) | F.coalesce(some, F.lit(False))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)", 1))


def robots_allows(path: Column, disallow: Column, allow: Column | None = None) -> Column:
    """The longest rule that the path begins with decides, allow wins a tie; no rules allow everything."""
    longest = lambda rules: F.coalesce(F.array_max(F.transform(F.filter(rules, lambda r: (r != "") & F.startswith(path, r)), F.length)), F.lit(-1))
    return longest(allow if allow is not None else F.array().cast("array<string>")) >= longest(F.coalesce(disallow, F.array().cast("array<string>")))
