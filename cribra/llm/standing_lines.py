"""Lines that stand in many documents of one source (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cribra.operators.components import connected_components
from cribra.tables import broadcast_if_small, materialize

MIN_DOCS = 5
MIN_SHARE = 0.03


def line_form(line):
    """Hash of the lower-cased letters of a line, null for a line without letters."""
    letters = F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")
    return F.when(letters != "", F.xxhash64(letters))


def standing_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """docs(article_id, source, text) -> (article_id, line_no, source, form, block).

    Graph of a source: nodes are line forms, weighted by the documents they stand in, edges join the forms of
    consecutive non-blank lines, weighted likewise. Nodes and edges of enough support stay; connected components are
    the blocks, a node without a strong edge being a block of its own. The rows are all occurrences of the blocks'
    lines. As a node needs no edge to stay, the blocks add no row and take none: they say which lines go together. Rows without a source have no lines here; null text has none; a document delivered twice counts twice.
    Line numbers count from 0, blank lines included.
    """
    docs = docs.where("source IS NOT NULL").select("article_id", "source", F.transform(F.split("text", "\n"), line_form).alias("forms"))
    docs = materialize(docs, "line-forms")
    need = docs.groupBy("source").agg(F.count("*").alias("docs")).withColumn("need", F.greatest(F.lit(float(min_docs)), F.col("docs") * F.lit(min_share))).select("source", "need")
    one = docs.select("source", F.explode(F.array_distinct("forms")).alias("form")).where("form IS NOT NULL")
    nodes = one.groupBy("source", "form").agg(F.count("*").alias("n")).join(need, "source").where("n >= need - 1e-9").select("source", "form", "n")
    nodes = materialize(nodes, "line-nodes")
    numbered = docs.select("article_id", "source", F.posexplode(F.filter(F.transform("forms", lambda f, i: F.struct(i.alias("line_no"), f.alias("form"))), lambda s: s["form"].isNotNull())).alias("nth", "s"))
    occ = numbered.select("article_id", "source", "nth", "s.line_no", "s.form").join(broadcast_if_small(nodes.select("source", "form")), ["source", "form"])
    occ = materialize(occ, "line-occurrences")
    w = Window.partitionBy("article_id", "source").orderBy("nth")
    steps = occ.select("article_id", "source", "form", (F.lead("nth").over(w) - F.col("nth")).alias("gap"), F.lead("form").over(w).alias("next")).where("gap = 1")
    edges = steps.groupBy("source", "form", "next").agg(F.countDistinct("article_id").alias("n")).join(need, "source").where("n >= need - 1e-9")
    node = lambda c: F.xxhash64("source", c)
    blocks = connected_components(edges.select(node("form").alias("a"), node("next").alias("b")))
    nodes = nodes.withColumn("node", node("form")).join(blocks, "node", "left").select("source", "form", F.coalesce("component", "node").alias("block"))
    nodes = materialize(nodes, "line-blocks")
    return occ.join(broadcast_if_small(nodes), ["source", "form"]).select("article_id", "line_no", "source", "form", "block")


def blocks(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(source, block, forms, lines, docs): of each block its different lines, their occurrences, and the documents it stands in."""
    lines = standing_lines(docs, min_docs, min_share)
    by = lines.groupBy("source", "block").agg(F.countDistinct("form").alias("forms"), F.count("*").alias("lines"))
    per = lines.select("source", "block", "article_id").distinct().groupBy("source", "block").agg(F.count("*").alias("docs"))
    return by.join(per, ["source", "block"])


def without_standing_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """docs(article_id, text) with the lines taken out; documents without such lines keep their text."""
    gone = lines.groupBy("article_id").agg(F.collect_list("line_no").alias("__gone"))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("__gone"), i))
    return docs.join(gone, "article_id", "left").withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop("__gone")
