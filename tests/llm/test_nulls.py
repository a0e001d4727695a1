"""Rows of nulls in every column, keys too, and repeated rows: nothing crashes, other rows keep their results."""

from pyspark.sql import functions as F

from cribra.llm import history, mixing, news, overlap, packing, pieces, quality, splits, standing_lines, truncation

BIG = 9_007_199_254_740_993  # no float holds it
LINES = "\n".join(["Inicio > Nación", "La junta aprobó ayer con reparos el plan de riego del valle y lo envió a los vecinos.", "Aviso legal"])


def test_articles(spark):
    schema = "article_id long, text string, url string, source string, authors array<string>, split string"
    rows = [(BIG + i, LINES, f"https://h.example/{i}", "s", ["Ana Ruiz", None], "train" if i % 2 else "val") for i in range(8)]
    df = spark.createDataFrame(rows + [(None,) * 6] * 2 + [(None, LINES, None, None, [None], None), (BIG, LINES, "https://h.example/0", "s", None, "val")], schema).coalesce(1)
    mine = {r[0] for r in rows}
    lines = news.wrapper_lines(df).collect()
    assert {r["article_id"] for r in lines if r["article_id"]} <= mine
    assert {r["article_id"] for r in standing_lines.standing_lines(df).collect()} == mine
    assert standing_lines.without_standing_lines(df, standing_lines.standing_lines(df)).count() == 12
    assert {r["article_id"] for r in pieces.pieces(df).collect()} - {None} == mine
    assert {r["article_id"] for r in splits.ComponentTable(spark).run(splits.record_nodes(df, ())).collect()} - {None} == mine
    assert news.judged(df).count() == 12 and quality.flag_no_prose(df.withColumnRenamed("text", "body")).count() == 12
    pairs = {tuple(r) for r in overlap.overlaps(df.withColumnRenamed("text", "body"), df, df).collect()}
    assert pairs == {(a, b) for a in mine for b in mine if a < b and (a - BIG) % 2 != (b - BIG) % 2}


def test_documents(spark):
    rows = [(BIG + i, "Uno dos tres. " * (i + 1), "es", "a") for i in range(6)]
    df = spark.createDataFrame(rows + [(None,) * 4] * 2 + [(None, "Texto sin clave.", None, None)] + rows[:1], "doc_id long, text string, lang string, source string").coalesce(1)
    mine = {r[0] for r in rows}
    assert {r["doc_id"] for r in packing.pack(df).collect()} - {None} == mine
    assert {r["doc_id"] for r in truncation.truncated(df).collect()} - {None} == mine
    targets = spark.createDataFrame([("a", 1.0, 1), (None, 0.0, None)], "source string, target_share double, max_repeats int")
    assert {r["doc_id"] for r in mixing.mix(df, targets).collect()} - {None} <= mine


def test_records(spark):
    schema = "scrape_id long, url string, content_hash string, scraped_at string"
    rows = [(BIG, "h.example/a", "k1", "2025-01-01T00:00:00Z"), (BIG + 1, "h.example/a", None, "2025-01-02T00:00:00Z"), (BIG + 1, "h.example/a", None, "2025-01-02T00:00:00Z"), (BIG + 2, None, "K1", None)]
    df = spark.createDataFrame(rows + [(None,) * 4] * 2 + [(None, None, "zz", "2025-01-01T00:00:00Z")], schema).withColumn("old", F.lit("clash"))
    assert {r[0] for r in history.repeats(df).collect()} == {BIG + 1, BIG + 2}
