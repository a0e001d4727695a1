"""Connected components by hooking and pointer jumping, all in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribra.tables import materialize


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """edges(a, b) of one type -> (node, component), component being the smallest node reached.

    Every round replaces each node's star by edges to the smallest neighbour (large-star, then small-star), which
    also shortens chains as pointer jumping does; rounds grow with the logarithm of the longest chain. Each round is
    written to the shared folder. Null ends and self-loops give no edge but a non-null node still gets a component.
    An empty input gives an empty result.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).where("node is not null").distinct()
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "cc")
    before = None
    for _ in range(max_rounds):
        # large-star: every neighbour above u goes to the smallest of u's neighbourhood
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: the smaller neighbours of u, and u itself, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = materialize(small, "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
