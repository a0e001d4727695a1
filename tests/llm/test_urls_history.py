import random

import pytest
from pyspark.sql import functions as F

from cribra.llm.addresses import canonical_url, content_key, instant
from cribra.llm.history import History, repeats

SAME = ["https://www.h.example/a/b-1", "http://h.example:80/a/b-1/", "HTTPS://WWW.H.EXAMPLE/a/b-1?utm_source=x#top", "https://m.h.example/a/b-1/amp?print=1", "  https://h.example/a/b%2D1?fbclid=2&amp=1\n", "https://h.example:443/a/b-1/amp/?view=print", "//h.example/a//b-1"]
OTHER = ["https://opinion.h.example/a/b-1", "https://h.example/a/b-1?pag=2", "https://h.example/a/b-1/video", "https://h.example/a/B-1", "https://h.example/a/b-2", "https://h.example/a/b-1?id=3"]


def test_canonical(spark):
    rows = spark.createDataFrame([(u,) for u in SAME + OTHER], "u string").select("u", canonical_url(F.col("u")).alias("c")).collect()
    got = {r["u"]: r["c"] for r in rows}
    assert {got[u] for u in SAME} == {"h.example/a/b-1"} and len({got[u] for u in OTHER} | {got[SAME[0]]}) == len(OTHER) + 1
    r = spark.createDataFrame([("https://h.example/n.php?b=2&a=1", "https://h.example/n.php?a=1&b=2", None, "  ", "https://h.example/a%f1o%zz", "https://h.example/a%C3%B1o")], "a string, b string, c string, d string, e string, f string")
    a, b, c, d, e, f = r.select(*[canonical_url(F.col(x)) for x in "abcdef"]).first()
    assert a == b and c is None and d is None and e and f == "h.example/año"


def test_keys(spark):
    h = ["AbC1", "abc1", None, "", "D41D8CD98F00B204E9800998ECF8427E", "0000", "null"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in h], "h string").select(content_key(F.col("h"))).collect()] == ["abc1", "abc1", None, None, None, None, None]
    t = ["2025-07-20T15:45:04.315000+00:00", "2025-07-20T10:45:04.315-05:00", "2025-07-20T15:45:04.315Z", "2025-07-20 15:45:04.315", "2025-07-20T10:45:04.315-0500", "x", None, "2025-07-20"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in t], "t string").select(instant(F.col("t")).cast("string")).collect()]
    assert set(got[:5]) == {"2025-07-20 15:45:04.315"} and got[5:] == [None, None, "2025-07-20 00:00:00"]


def brute(rows):
    pages, hashes, out = set(), set(), set()
    for t, i, u, h in sorted((r[3], r[0], r[1], r[2]) for r in rows):
        if u in pages and u is not None or h is not None and h in hashes:
            out.add(i)
        else:
            pages |= {u} - {None}
            hashes |= {h} - {None}
    return out


@pytest.mark.parametrize("one_task", [0, 200_000])
def test_repeats_against_brute_force(spark, monkeypatch, one_task):
    """Eight daily batches, each in one task or by rounds, with merges of segments and several buckets on the way."""
    from cribra.llm import history
    from cribra.operators import ledger

    monkeypatch.setattr(history, "ONE_TASK", one_task)
    monkeypatch.setattr(ledger, "ONE_TASK", one_task)
    monkeypatch.setattr(history, "KEYS_PER_BUCKET", 4)
    monkeypatch.setattr(history, "FAN", 3)
    rng = random.Random(one_task)
    rows = [(i, rng.choice([None] + [f"h.example/{k}" for k in range(25)]), rng.choice([None, "hot", "hot"] + [f"{k:04x}" for k in range(90)]), f"2025-01-{rng.randrange(1, 9):02d}T0{rng.randrange(4)}:00:00Z") for i in range(160)]
    df = spark.createDataFrame(rows, "scrape_id long, url string, content_hash string, scraped_at string").withColumn("id", F.lit("other")).withColumn("at", F.lit(1))
    assert {r[0] for r in repeats(df).collect()} == brute(rows)


def test_empty_and_incremental(spark):
    df = spark.createDataFrame([], "scrape_id long, url string, content_hash string, scraped_at string")
    assert repeats(df).count() == 0
    h = History(spark)
    one = [(1, "h.example/a", "k1", "2025-01-01T00:00:00Z"), (2, "h.example/b", None, "x")]
    two = [(3, "h.example/c", "K1", "2025-01-02T00:00:00Z"), (4, "h.example/c", "k2", "2025-01-02T01:00:00Z"), (5, None, None, None)]
    assert h.batch(spark.createDataFrame(one, df.schema)).count() == 0
    # row 3 repeats 1, so its page isn't held and 4 is accepted
    assert [r[0] for r in h.batch(spark.createDataFrame(two, df.schema)).collect()] == [3]


def test_a_reopened_store_goes_on_and_reads_only_its_buckets(spark, monkeypatch):
    from cribra.llm import history

    monkeypatch.setattr(history, "KEYS_PER_BUCKET", 8)
    monkeypatch.setattr(history, "FAN", 4)
    schema = "scrape_id long, url string, content_hash string, scraped_at string"
    path = History(spark).path
    for day in range(1, 7):
        rows = [(1000 * day + i, f"h.example/{day}/{i}", None, f"2025-01-{day:02d}T00:00:00Z") for i in range(60)]
        again = [(1000 * day + 900, f"https://www.h.example/{day - 1}/7?utm_source=x", None, f"2025-01-{day:02d}T01:00:00Z")] if day > 1 else []
        h = History(spark, path)  # a new object each time
        assert [r[0] for r in h.batch(spark.createDataFrame(rows + again, schema)).collect()] == [r[0] for r in again]
    h = History(spark, path)
    assert h.batch(spark.createDataFrame([(1, "h.example/3/9", None, "2025-02-01T00:00:00Z"), (2, "h.example/new", None, "2025-02-01T00:00:00Z")], schema)).count() == 1
    read, there = h.read
    assert 0 < read <= 2 * len(h.segments()) < there / 2
    # a batch that is run again, as after a failure, finds none of its own records
    assert h.batch(spark.createDataFrame([(2, "h.example/new", None, "2025-02-01T00:00:00Z")], schema)).count() == 0
