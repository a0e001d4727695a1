"""Candidate addresses of a source: tiers, order, limits, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cribra.functions.urls import passes_filters
from cribra.operators.ledger import first_wins


def tiers(feeds: DataFrame, sitemaps: DataFrame, crawled: DataFrame, catalogue: DataFrame, most: int) -> DataFrame:
    """(source, url, ord) of each tier, and the catalogue (name, mode, url_filters) -> (source, url, tier, ord).

    Feed addresses count once, the first of each. Sitemap addresses that no feed has are added for sources whose feeds
    give fewer than twice `most`; crawled ones where the two give none. Filters hold for sitemap and crawled addresses
    of sources in sitemap mode.
    """
    cat = catalogue.select(F.col("name").alias("source"), "mode", "url_filters")
    feed = first_wins(feeds.where("url <> ''"), ["source", "url"], ["ord"])
    enough = feed.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * most).select("source")
    allowed = lambda d: d.join(cat, "source").where((F.col("mode") != "sitemap") | passes_filters(F.col("url"), F.col("url_filters"))).select("source", "url", "ord")
    site = allowed(sitemaps).join(enough, "source", "left_anti").join(feed.select("source", "url"), ["source", "url"], "left_anti")
    have = feed.select("source").union(site.select("source")).distinct()
    crawl = allowed(crawled).join(have, "source", "left_anti")
    tag = lambda d, t: d.select("source", "url", F.lit(t).alias("tier"), "ord")
    return tag(feed, 0).union(tag(site, 1)).union(tag(crawl, 2))


def shuffle_limit(df: DataFrame, group: list[str], key: str, seed: int, most: int) -> DataFrame:
    """At most `most` rows of each group in the order of md5(seed, key): a repeatable shuffle and cut."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key)))
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*group).orderBy(h, key))).where(F.col("pos") <= most)


def select_sources(catalogue: DataFrame, categories: list[str] | None = None, sources: list[str] | None = None) -> DataFrame:
    """The named sources, else those of the categories, else all; unknown names give nothing."""
    if sources:
        return catalogue.where(F.col("name").isin(sources))
    if categories:
        return catalogue.where(F.col("category").isin(categories))
    return catalogue


def by_category(catalogue: DataFrame) -> DataFrame:
    """Names by category, in order of name; the catalogue is a small dimension."""
    return catalogue.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"), F.count("*").alias("n"))
