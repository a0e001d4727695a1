"""Mixing sources to target weights by a low-discrepancy schedule (problem 9)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribra.llm.tokens import DEFAULT_VOCABULARY, Tokens
from cribra.operators.prefix import exclusive_prefix
from cribra.tables import emptied, filled, materialize

#: Tokens in a block, the unit of the schedule.
BLOCK = 4096
GOLDEN = (math.sqrt(5) - 1) / 2


def token_counts(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """docs(doc_id, source, text) -> (doc_id, source, tokens), texts without tokens left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = Tokens(vocabulary)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [tok.count(t) for t in pdf["text"]]})

    out = docs.select(filled("doc_id"), "source", "text").mapInPandas(run, "doc_id long, source string, tokens long").where("tokens > 0")
    return out.withColumn("doc_id", emptied("doc_id"))


def budgets(counts: DataFrame, targets: DataFrame, total: float | None = None) -> list[tuple[str, float, int, int, float]]:
    """(source, share, repeats allowed, tokens, tokens to take) by source; targets is the fixed table of weights.

    Without a total the mix is the largest in which every source that has documents reaches its share within its
    repeats. With one, a source whose repeats end before its share gives what it has.
    """
    have = {r["source"]: r["n"] for r in counts.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    rows = [(r["source"], r["target_share"], max(int(r["max_repeats"] or 1), 0), have.get(r["source"], 0)) for r in targets.where("target_share > 0").orderBy("source").collect()]
    most = min((n * k / w for _, w, k, n in rows if n and k), default=0.0)
    size = most if total is None else float(total)
    return [(s, w, k, n, min(size * w, float(n * k))) for s, w, k, n in rows]


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, block: int = BLOCK, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """docs(doc_id, source, text), targets(source, target_share, max_repeats) -> (slot, source, doc_id, repeat, tokens).

    Each source's documents form a stream, shuffled by hash anew for every pass; the stream is cut at the source's
    budget to the nearest document, and into blocks of equal tokens. Slot j takes the source in whose part of the
    cumulative weights the point frac((j + 1) x golden ratio) falls; a source's k-th slot holds its k-th block. Any
    stretch of slots so has each source close to its share. repeat counts a document's passes from 0.
    """
    spark = docs.sparkSession
    names = [r["source"] for r in targets.select("source").distinct().collect()]  # the fixed dimension table
    counts = materialize(token_counts(docs.where(F.col("source").isin(names)), vocabulary), "mix-tokens")
    plan = [(s, w, n, b, int(math.ceil(b / n - 1e-9))) for s, w, k, n, b in budgets(counts, targets, total) if n and b > 0]
    schema = "slot long, source string, doc_id long, repeat int, tokens long"
    if not plan:
        return spark.createDataFrame([], schema)
    p = F.broadcast(spark.createDataFrame([(s, n, b, k) for s, _, n, b, k in plan], "source string, total long, budget double, passes int"))
    passes = counts.join(p, "source").select("*", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("repeat"))
    passes = passes.withColumn("key", F.xxhash64("doc_id", "repeat"))
    bits = max(1, min(30, round(math.log2(max(2, sum(n for _, _, n, _, _ in plan) / 20_000_000 * 64)))))
    placed = exclusive_prefix(passes, ["source", "repeat"], F.expr(f"shiftright(key, {64 - bits})"), ["key", "doc_id"], F.col("tokens"), "before")
    placed = placed.withColumn("start", F.col("repeat") * F.col("total") + F.col("before")).where(F.col("start") + F.col("tokens") / 2 <= F.col("budget"))
    placed = placed.select("source", "doc_id", "repeat", "tokens", F.expr(f"start div {block}").alias("nth"))
    slots = int(sum(b for *_, b, _ in plan) // block) + len(plan)
    u, edge, source, whole = F.expr(f"(id + 1) * {GOLDEN!r}D % 1"), 0.0, None, sum(w for _, w, *_ in plan)
    for s, w, *_ in plan:
        edge += w / whole
        source = F.when(u < edge, s) if source is None else source.when(u < edge, s)
    sched = spark.range(slots).select("id", source.otherwise(plan[-1][0]).alias("source"))
    sched = exclusive_prefix(sched, ["source"], F.expr("shiftright(id, 16)"), ["id"], F.lit(1), "nth").select(F.col("id").alias("slot"), "source", "nth")
    out = placed.join(sched, ["source", "nth"], "left")
    return out.select(F.coalesce("slot", F.lit(slots) + F.col("nth")).alias("slot"), "source", "doc_id", "repeat", "tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, tokens, share): what each source of the targets reached; 0 for one without documents."""
    by = mixed.groupBy("source").agg(F.countDistinct("doc_id").alias("documents"), F.sum("tokens").alias("tokens"))
    total = by.agg(F.sum("tokens")).first()[0] or 1
    j = targets.select("source", "target_share").join(by, "source", "left")
    return j.select("source", "target_share", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.lit(total), F.lit(0.0)).alias("share"))
