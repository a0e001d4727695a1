"""Splits that keep related records together (problem 4)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cribra.llm.persons import fold, persons
from cribra.operators.components import connected_components
from cribra.tables import delete_path, emptied, filled, list_names, materialize, path_exists, scratch_path

SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}
#: Components that hold at least this share of all records are placed one by one, so there are at most 1 / LARGE.
LARGE = 0.002


def outlet_keys(sources: DataFrame) -> tuple[str, ...]:
    """Letters of the source names, the fixed dimension table."""
    return tuple(sorted({"".join(c for c in fold(r["name"]) if c.isalpha()) for r in sources.select("name").where("name IS NOT NULL").distinct().toLocalIterator()} - {""}))


def record_nodes(news: DataFrame, outlets: tuple[str, ...]) -> DataFrame:
    """news(article_id, source, authors) -> (article_id, nodes): s:source, then p:person for every person named.

    A record without source and person has the node a:id alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[str]] = {}
        for pdf in batches:
            nodes = []
            for a, source, authors in zip(pdf["article_id"], pdf["source"], pdf["authors"]):
                n = [f"s:{source}"] if source else []
                for x in authors if authors is not None else ():
                    if x not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[x] = persons(x, outlets)
                    n += [f"p:{p}" for p in known[x]]
                nodes.append(list(dict.fromkeys(n)) or [f"a:{a}"])
            yield pd.DataFrame({"article_id": pdf["article_id"], "nodes": nodes})

    out = news.select(filled("article_id"), "source", "authors").mapInPandas(run, "article_id long, nodes array<string>")
    return out.withColumn("article_id", emptied("article_id"))


def links(nodes: DataFrame) -> DataFrame:
    """Distinct edges (a, b) of each record's star around its first node; a node alone is an edge to itself."""
    star = nodes.select(F.col("nodes")[0].alias("a"), F.explode("nodes").alias("b"))
    return star.distinct()


def components_of(nodes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, component). known: a persisted table of the same form, whose components are links like any other."""
    e = links(nodes)
    if known is not None:
        e = e.union(known.select(F.col("component").alias("a"), F.col("node").alias("b")))
    return connected_components(e)


def assign(nodes: DataFrame, known: DataFrame | None = None, shares: dict[str, float] = SHARES) -> tuple[DataFrame, DataFrame]:
    """-> (article_id, component, split) and the component table (node, component, split, records) to persist.

    known(node, component, split, records): components of earlier runs, with records of this run or not, keep their split.
    A component in which old ones of different splits meet is quarantined: its records get the split ``quarantine`` and
    wait for a decision, as no split is right for them. New components fill the splits that lack most: large ones from the largest down, one by one (there
    are at most 1 / LARGE); all others, by hash, in proportion to what is lacking then, so that records arriving later
    change nothing for them.
    """
    comp = materialize(components_of(nodes, known), "components")
    rec = nodes.select("article_id", F.col("nodes")[0].alias("node")).join(comp, "node").select("article_id", "component")
    rec = materialize(rec, "record-components")
    sizes = rec.groupBy("component").agg(F.count("*").alias("n"))
    if known is not None:
        # an old component's name is one of its nodes
        old = known.select(F.col("component").alias("node"), "split", "records").distinct().join(comp, "node")
        old = old.groupBy("component").agg(F.min("split").alias("lo"), F.max("split").alias("hi"), F.sum("records").alias("before"))
        old = old.select("component", "before", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit("quarantine")).alias("old"))
        sizes = sizes.join(old, "component", "full")
    else:
        sizes = sizes.withColumns({"before": F.lit(0), "old": F.lit(None).cast("string")})
    sizes = materialize(sizes.select("component", "old", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) + F.coalesce("before", F.lit(0))).cast("long").alias("records")), "component-sizes")
    total = sizes.agg(F.sum("records")).first()[0] or 0
    lack = {s: total * w for s, w in shares.items()}
    for r in sizes.where("old IS NOT NULL").groupBy("old").agg(F.sum("records").alias("n")).collect():
        if r["old"] in lack:
            lack[r["old"]] -= r["n"]
    placed = []
    for r in sizes.where(F.col("old").isNull() & (F.col("n") >= LARGE * total)).orderBy(F.desc("n"), "component").collect():
        s = max(lack, key=lambda k: (lack[k], k))
        lack[s] -= r["n"]
        placed.append((r["component"], s))
    rest = {s: max(v, 0.0) for s, v in lack.items()}
    whole = sum(rest.values()) or 1.0
    u, edge, small = F.pmod(F.xxhash64("component", F.lit(17)), F.lit(1 << 20)) / float(1 << 20), 0.0, None
    for s, v in rest.items():
        edge += v / whole
        small = F.when(u < edge, s) if small is None else small.when(u < edge, s)
    small = small.otherwise(max(rest, key=lambda k: (rest[k], k)))
    big = sizes.sparkSession.createDataFrame(placed, "component string, placed string")
    split = sizes.join(F.broadcast(big), "component", "left").select("component", F.coalesce("old", "placed", small).alias("split"), "records")
    split = materialize(split, "component-splits")
    return rec.join(split, "component").select("article_id", "component", "split"), comp.join(split, "component").select("node", "component", "split", "records")


class ComponentTable:
    """The persisted component table under a path: run(nodes) assigns new records and writes the next version.

    The version comes from the path, so a new object goes on where another ended. A version counts once it was written
    to its end; the last one before it stays, for a run that is repeated.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "component-table")

    def version(self) -> int:
        found = [int(n[1:]) for n in list_names(self.spark, self.path) if n[:1] == "v" and n[1:].isdigit() and path_exists(self.spark, f"{self.path}/{n}/_SUCCESS")]
        return max(found, default=0)

    def read(self) -> DataFrame | None:
        """(node, component, split, records) of the last version, null before the first. records: of the component, in all runs."""
        v = self.version()
        return self.spark.read.schema("node string, component string, split string, records long").parquet(f"{self.path}/v{v}") if v else None

    def run(self, nodes: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
        rec, table = assign(nodes, self.read(), shares)
        v = self.version()
        table.write.mode("overwrite").parquet(f"{self.path}/v{v + 1}")
        delete_path(self.spark, f"{self.path}/v{v - 1}")
        return rec


def linked_sources(table: DataFrame) -> DataFrame:
    """table(node, component) -> (source_a, source_b), source_a < source_b, of all sources in one component: the form the
    pairs are asked in."""
    comp = table.where("node LIKE 's:%'").select(F.expr("substring(node, 3)").alias("source"), "component")
    comp = materialize(comp, "source-components")
    a, b = comp.toDF("source_a", "component"), comp.toDF("source_b", "component")
    return a.join(b, "component").where("source_a < source_b").select("source_a", "source_b")
