"""The pN_ queries: each applies its problem's operator to the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cribra.llm import history, mixing, overlap, packing, pieces, splits, standing_lines, truncation
from cribra.llm import news as news_ops
from cribra.tables import materialize, table

Query = Callable[[SparkSession, str], DataFrame]


def news(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    t = table(spark, d, "labeled_news")
    return t.select(*columns) if columns else t


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeats(table(spark, d, "scraped_urls").select("scrape_id", "url", "content_hash", "scraped_at"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return standing_lines.standing_lines(news(spark, d, "article_id", "source", "text")).select("article_id", "line_no")


def p2_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = news(spark, d, "article_id", "source", "text")
    return standing_lines.without_standing_lines(docs, standing_lines.standing_lines(docs)).select("article_id", "text")


def p2_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of each source: how many forms they have and in how many articles they stand."""
    return standing_lines.blocks(news(spark, d, "article_id", "source", "text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return news_ops.no_prose(news(spark, d, "article_id", "text", "url", "source"))


def p3_stats(spark: SparkSession, d: str) -> DataFrame:
    from cribra.llm.quality import STATS, with_stats

    df = with_stats(news(spark, d, "article_id", "text"), "text")
    return df.select("article_id", *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c in STATS])


def _component_table(spark: SparkSession, d: str) -> tuple[splits.ComponentTable, list[DataFrame]]:
    """The table after the articles have come in two increments, those labelled up to the median time first, and what
    each increment was assigned."""
    t = news(spark, d, "article_id", "source", "authors", "labeled_at")
    outlets, table_ = splits.outlet_keys(table(spark, d, "sources")), splits.ComponentTable(spark)
    middle = t.select(F.percentile_approx(F.unix_micros(F.col("labeled_at").cast("timestamp")), 0.5)).first()[0]
    early = F.coalesce(F.unix_micros(F.col("labeled_at").cast("timestamp")) <= F.lit(middle), F.lit(True))
    return table_, [table_.run(materialize(splits.record_nodes(t.where(w), outlets), "record-nodes")) for w in (early, ~early)]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.linked_sources(_component_table(spark, d)[0].read())


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """The splits of both increments; a later merge of components in different splits is seen from the second one on."""
    first, second = _component_table(spark, d)[1]
    return first.union(second)


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    t = news(spark, d, "article_id", "text", "url", "source")
    bodies = news_ops.judged(t).where("NOT no_prose").select("article_id", "body")
    return overlap.overlaps(bodies, t.select("article_id", "url"), table(spark, d, "split_manifest").select("article_id", "split"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d)


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every compared article with its class and the number of classes of the other side it agrees with."""
    t = news(spark, d, "article_id", "text", "url", "source")
    bodies = news_ops.judged(t).where("NOT no_prose").select("article_id", "body")
    return overlap.classes(bodies, table(spark, d, "split_manifest").select("article_id", "split"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(_overlaps(spark, d), news(spark, d, "article_id", "source"), table(spark, d, "split_manifest"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Articles of more than one piece: those above the limit."""
    return pieces.pieces(news(spark, d, "article_id", "text")).where("piece = 1").select("article_id")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(news(spark, d, "article_id", "text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return news_ops.wrapper_lines(news(spark, d, "article_id", "text", "url", "source"))


def p7_bodies(spark: SparkSession, d: str) -> DataFrame:
    t = news(spark, d, "article_id", "text", "url", "source")
    return news_ops.judged(t).select("article_id", "no_prose", "body")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(documents(spark, d).select("doc_id", "text"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, and how related their items."""
    return packing.report(packing.packed(documents(spark, d).select("doc_id", "text")))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(documents(spark, d).select("doc_id", "source", "text"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(documents(spark, d).select("doc_id", "source", "text"), targets), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(documents(spark, d)).where("cut").select("doc_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return truncation.truncated_share(docs, truncation.truncated(docs))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


_LINES = r"""lines AS (SELECT article_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM labeled_news WHERE source IS NOT NULL),
forms AS (SELECT article_id, source, CAST(line_no AS INTEGER) AS line_no, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS form FROM lines),
standing AS (SELECT source, form FROM forms WHERE form <> '' GROUP BY source, form HAVING count(DISTINCT article_id) >= greatest(5, 0.03 * (SELECT count(*) FROM labeled_news n WHERE n.source = forms.source)) - 1e-9)"""
_TOKS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '')"


def oracle_sql() -> dict[str, str]:
    from cribra.llm.quality import COMMON

    common = ", ".join(f"'{w}'" for w in COMMON)
    return {
        "p2_found": f"WITH {_LINES} SELECT article_id, line_no FROM forms JOIN standing USING (source, form)",
        "p3_stats": rf"""WITH a AS (SELECT article_id, {_TOKS} AS t, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x{{0b}}\f\r]')) AS ls, length(regexp_replace(text, '[ \t\n\x{{0b}}\f\r]+', '', 'g')) AS solid FROM labeled_news),
b AS (SELECT *, len(t) AS w, len(ls) AS n, length(array_to_string(t, '')) AS an, length(regexp_replace(array_to_string(t, ''), '[^0-9]+', '', 'g')) AS dg, len(list_filter(ls, lambda l: regexp_matches(l, '[.!?…:][ \t\n\x{{0b}}\f\r»”"'')\]]*$'))) AS e, len(list_filter(t, lambda x: x IN ({common}))) AS c, len(list_distinct(t)) AS u FROM a)
SELECT article_id, CAST(w AS INTEGER) AS words, CAST(n AS INTEGER) AS lines, round(CASE WHEN w > 0 THEN an / w ELSE 0 END, 6) AS mean_word_len, round(CASE WHEN solid > 0 THEN 1 - least(an, solid) / solid ELSE 0 END, 6) AS symbol_ratio, round(CASE WHEN n > 0 THEN e / n ELSE 0 END, 6) AS end_punct_share,
round(CASE WHEN w > 0 THEN c / w ELSE 0 END, 6) AS common_share, round(CASE WHEN n > 0 THEN w / n ELSE 0 END, 6) AS words_per_line, round(CASE WHEN an > 0 THEN dg / an ELSE 0 END, 6) AS digit_share, round(CASE WHEN w > 0 THEN u / w ELSE 0 END, 6) AS distinct_share FROM b""",
        "p6_found": "SELECT article_id FROM labeled_news WHERE length(text) > 3000",
    }
