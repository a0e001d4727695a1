import random

import pytest
from pyspark.sql import functions as F

from cribra.axes import AXES
from cribra.functions import responses
from cribra.operators import evaluation, ledger, partition, scores
from cribra.operators.components import connected_components
from cribra.operators.prefix import exclusive_prefix


def full(**kw):
    import json

    return json.dumps({"is_political": 1, **{a: 50 for a in AXES}} | kw)


JUDGED = [
    (full(), (1, 50.0)), ("```json\n" + full(populismo=140) + "\n```", (1, 100.0)), ("```\n" + full(populismo=-5) + "```", (1, 0.0)), (full(populismo="50"), None), (full(populismo=True), (1, 1.0)),
    (full() + "x", None), (full() + "," + full(), None), ("[1]", None), ("3", None), ("null", None), (None, None), ("", None), (full()[:-9], None), (full(is_political="1"), (1, 50.0)), (full(is_political=None), None), (full(populismo=None), None), (full(populismo=12.5), (1, 12.5)),
]


def test_judge(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(JUDGED)], "i int, response string")
    got = {r["i"]: r["p"] and (r["p"]["is_political"], r["p"]["populismo"]) for r in responses.with_parsed(df, "response", responses.judge).collect()}
    assert got == {i: w for i, (_, w) in enumerate(JUDGED)}


def test_verdict(spark):
    cases = [('{"is_article": true, "category": "x"}', True), ('{"is_article": "false", "category": "x"}', True), ('{"is_article": 0, "category": "x"}', False), ('{"is_article": null, "category": "x"}', False), ('{"category": "x"}', None), ('{"is_article": true}', None), ("{", None), (None, None)]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, response string")
    got = {r["i"]: r["p"] and r["p"]["is_article"] for r in responses.with_parsed(df, "response", responses.verdict).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 5), (500, None)]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        else:
            find(a if a is not None else b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.choice([1, 2, None])) for i in range(500)]
    got = exclusive_prefix(spark.createDataFrame(rows, "g string, i int, v int"), ["g"], F.expr("i div 50"), ["i"], F.col("v"), "p").collect()
    run = {"a": 0, "b": 0}
    want = {}
    for g, i, v in rows:
        want[i] = run[g]
        run[g] += v or 0
    assert {r["i"]: r["p"] for r in got} == want


def test_ledger(spark):
    df = spark.createDataFrame([(1, "u", "h"), (2, "u", "k"), (3, "v", "h"), (4, None, None), (5, "w", None), (6, "w", None), (7, "z", "q")], "i int, url string, content_hash string")
    known = spark.createDataFrame([("z", "zz"), (None, None)], "url string, content_hash string")
    assert sorted(r["i"] for r in ledger.accept(df, known, ["i"]).collect()) == [1, 4, 5]
    assert ledger.upsert(known, df.select("url", "content_hash")).count() == 2 + 6


def loop(rows, urls=(), hashes=()):
    """Ids that a plain loop over rows (id, url, hash) in order accepts."""
    u, h, out = set(urls), set(hashes), []
    for i, a, b in rows:
        if a is not None and a in u or b is not None and b in h:
            continue
        out.append(i)
        u |= {a} - {None}
        h |= {b} - {None}
    return out


@pytest.mark.parametrize("one_task", [0, 200_000])
def test_accept_against_a_loop(spark, monkeypatch, one_task):
    monkeypatch.setattr(ledger, "ONE_TASK", one_task)
    schema = "i int, url string, content_hash string"
    none = spark.createDataFrame([], "url string, content_hash string")
    # row 2 is passed over for its url, so its hash stays open for row 3; and a chain of such rows
    chain = [(1, "u", "h"), (2, "u", "g"), (3, "v", "g")] + [(10 + k, f"c{(k + 1) // 2}", f"d{k // 2}") for k in range(12)]
    assert sorted(r["i"] for r in ledger.accept(spark.createDataFrame(chain, schema), none, ["i"]).collect()) == loop(chain)
    rng = random.Random(one_task)
    rows = [(i, rng.choice([None] + [f"u{k}" for k in range(30)]), rng.choice([None, "hot"] + [f"h{k}" for k in range(40)])) for i in range(150)]
    known = spark.createDataFrame([("u3", None), (None, "h4")], "url string, content_hash string")
    got = ledger.accept(spark.createDataFrame(rows, schema).withColumn("id", F.lit("x")).withColumn("key", F.lit(1)), known, ["i"])
    assert sorted(r["i"] for r in got.collect()) == loop(rows, ["u3"], ["h4"])
    assert ledger.accept(spark.createDataFrame([], schema), known, ["i"]).count() == 0
    assert ledger.accept(spark.createDataFrame([(1, "a", "b")] * 3, schema), none, ["i"]).count() == 1


def test_first_wins_keeps_one_of_ties(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 1, "y"), ("b", 2, None), ("b", None, "z"), (None, 1, "n"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "k string, o int, v string").withColumn("m", F.create_map(F.lit("q"), F.lit(1)))
    for _ in range(2):
        got = ledger.first_wins(df.repartition(3), ["k"], ["o"]).collect()
        assert sorted(str(r["k"]) for r in got) == ["None", "None", "a", "b"] and {r["o"] for r in got if r["k"] == "b"} == {None}
    assert len({tuple(r["v"] for r in ledger.first_wins(df.repartition(n), ["k"], ["o"]).where("k = 'a'").collect()) for n in (1, 2, 4)}) == 1


def test_accept_limit_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.random() < 0.3) for i in range(400)]
    want, seen = set(), {}
    for g, i, ok in rows:
        if seen.get(g, 0) < 7:
            want.add(i)
            seen[g] = seen.get(g, 0) + ok
    df = spark.createDataFrame(rows, "g string, i int, ok boolean")
    assert {r["i"] for r in ledger.accept_limit(df, F.col("ok"), ["g"], ["i"], 7).collect()} == want
    assert ledger.accept_limit(df, F.col("ok"), ["g"], ["i"], 0).count() == 0


def test_scores(spark):
    df = spark.createDataFrame([(1, 1, *[0.5] * 8), (2, 1, *[None] * 8), (3, 0, *[0.9] * 8)], "id int, is_political int, " + ", ".join(f"{a} double" for a in AXES))
    assert df.select(scores.main_axis()).distinct().collect()[0][0] == AXES[0]
    top = scores.top_n(scores.to_long(scores.political(df), ["id"]), 1, "id").collect()
    assert len(top) == 8 and {r["id"] for r in top} == {1}
    m = spark.createDataFrame([({AXES[1]: 0.7},)], "labels map<string,double>").select(*[F.lit(None).cast("double").alias(a) for a in AXES], "labels")
    assert m.select(scores.main_axis("labels")).first()[0] == AXES[1]
    assert [r[0] for r in spark.createDataFrame([(0.025,), (0.035,), (None,)], "x double").select(scores.percent(F.col("x"))).collect()] == [2, 4, None]


@pytest.mark.parametrize("n", [0, 1, 6, 7, 100])
def test_splits(spark, n):
    a, v, t = partition.split_sizes(n)
    m = partition.manifest(n)
    assert a + v + t == n and sorted(sum(m.values(), [])) == list(range(n)) and len(m["val"]) == v
    got = partition.assign_splits(spark.range(n).toDF("id"), "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {k: x for k, x in zip(("train", "val", "test"), (a, v, t)) if x}


@pytest.mark.parametrize("length,stride", [(0, 6), (8, 6), (9, 6), (20, 6), (26, 9), (30, 12), (3, 12)])
def test_windows(spark, length, stride):
    want, start = [], 0
    tok = list(range(length))
    if length <= 8:
        want = [tok]
    else:
        while start < length:
            want.append(tok[start : start + 8])
            if start + 8 >= length:
                break
            start += stride
    df = spark.createDataFrame([(tok,)], "t array<int>")
    assert [r["chunk"] for r in partition.windows(df, "t", 10, stride).orderBy("chunk_idx").collect()] == want
    with pytest.raises(ValueError):
        partition.chunks(df, "t", "other")


def test_ordinals_and_tokens(spark):
    keys = [-120_000, -3, 0, 7, 49_999, 50_000, 50_001, 10**12]
    df = spark.createDataFrame([(k,) for k in reversed(keys)] + [(None,)], "k long").withColumn("ord", F.lit("clash"))
    assert {r["k"]: r["ord"] for r in partition.with_ordinal(df, "k", start=5).collect()} == {k: i + 5 for i, k in enumerate(keys)}
    t = partition.tokenize(spark.createDataFrame([("uno dos", 1), (None, 2), ("", 3)], "t string, tokens int"), "t", partition.WordLengths)
    assert [r["tokens"] for r in t.collect()] == [[3, 3], None, []]


def test_evaluation(spark):
    df = spark.createDataFrame([("e", 42, "x", 0.5, float("nan")), ("e", 43, "x", 0.7, 0.1), ("f", 42, "x", None, 0.2), ("g", 42, "x", 0.9, 0.3)], "encoder string, seed int, axis string, r2 double, mse double")
    s = evaluation.axis_summary(df.withColumn("mse", F.nanvl("mse", F.lit(None))))
    by = {r["encoder"]: r for r in evaluation.ranks(s).collect()}
    assert (by["g"]["rank"], by["e"]["rank"], by["f"]["rank"]) == (1, 2, 3) and by["g"]["r2_std"] == 0 and abs(by["e"]["r2_std"] - 0.141421) < 1e-6
    w = evaluation.winners(s).first()
    assert (w["best_r2"], w["best_mse"]) == ("g", "e")
    nan = float("nan")
    s2 = spark.createDataFrame([("a", AXES[0], 0.5, nan), ("b", AXES[0], nan, 0.2), ("c", AXES[0], None, None), ("a", AXES[1], nan, 0.1), ("b", AXES[1], nan, nan)], "encoder string, axis string, r2_mean double, mse_mean double")
    w = {r["axis"]: (r["best_r2"], r["best_mse"]) for r in evaluation.winners(s2).collect()}
    assert w == {AXES[0]: ("a", "b"), AXES[1]: ("a", "a")}
    assert {r["encoder"]: r["ranks"] for r in evaluation.mean_ranks(evaluation.ranks(s2)).collect()} == {"a": "1,1", "b": "2,2", "c": "3"}
    one = spark.createDataFrame([("a__b__seed7", None, None), ("odd", "al", 3), ("odd", None, None)], "k string, a string, s int")
    e, n = evaluation.parse_run_key(F.col("k"), F.col("a"), F.col("s"))
    assert [tuple(r) for r in one.select(e, n).collect()] == [("a__b", 7), ("al", 3), ("odd", 0)]
    r = evaluation.regression_metrics(spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (None, 1.0)], "y double, p double"), [], "y", "p").first()
    assert (r["n"], r["mse"], r["r2"]) == (2, 0.5, -1.0)
    assert evaluation.masked_loss(spark.createDataFrame([(1.0, 2.0)], "y double, p double"), ["y"], ["p"], F.lit(False)).first()[0] == 0.0
