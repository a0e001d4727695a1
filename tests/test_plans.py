import json

from pyspark.sql import functions as F

from cribra.axes import AXES
from cribra.operators import discovery, evaluation
from cribra.plans import benchmark, jobs, models, pipelines, registry, report
from cribra.sources import config, dimensions, feeds, html, jsonl, manifest
from cribra.streaming import incremental


def test_html():
    page = "<html><head><title>A &amp; B</title><meta name=author content='Ana; Leo'></head><body><nav>menú</nav><article><p>Uno <b>dos<p>tres &lt;4<script>x<y</script></article><footer>pie</footer><a href='/k'>k</a>"
    t, title, authors, date, links = html.extract(page)
    assert (t, title, authors, date, links) == ("Uno dos\ntres <4", "A & B", ["Ana", "Leo"], None, ["/k"])
    assert html.extract(None) == ("", "", [], None, []) and html.extract("sin etiquetas")[0] == "sin etiquetas"


def test_feeds_and_policies(spark):
    rss = "<rss><channel><link>http://h</link><item><link>http://h/1</link></item><item><link> </link></item></channel></rss>"
    assert feeds.feed_links(rss) == ["http://h/1"] and feeds.feed_links("<") == [] and feeds.feed_links(None) == []
    assert feeds.sitemap_links("<urlset xmlns='x'><url><loc>http://h/2</loc></url></urlset>") == ["http://h/2"]
    got = feeds.discover(spark.createDataFrame([("s", "a"), ("s", "b")], "source string, address string"), lambda a: rss if a == "a" else 1 / 0, feeds.feed_links).collect()
    assert [(r["source"], r["url"]) for r in got] == [("s", "http://h/1")]
    assert feeds.robots_rules("User-agent: x\nDisallow: /\n\nUser-agent: *\nDisallow: /a # c\nAllow: /a/b") == (["/a"], ["/a/b"]) and feeds.robots_rules(None) == ([], [])
    import random

    assert feeds.backoff(9, random.Random(1)) == 30.0 and feeds.retry_delay(1, "429") == 60.0 and feeds.retry_delay(1, "x") == 4.0 and feeds.per_minute(1.5) == 40.0


def test_config_and_runs():
    groups = {"model": {"a": {"lr": "2e-5", "n": "3"}, "b": {"lr": "1"}}}
    assert config.compose({"model": "a"}, groups, ["model.n=4"]) == {"model": {"lr": 2e-5, "n": 4}} and config.compose({"model": "a"}, groups, ["model=b"]) == {"model": {"lr": 1}}
    assert benchmark.plan(["a", "b"], [1, 2], ["b"]) == [("a", 1), ("a", 2)] and benchmark.precision("auto", 8) == "bf16" and benchmark.precision("auto", None) == "fp32"
    bad = lambda m, s: 1 / 0
    assert len(benchmark.run_all([("a", 1), ("a", 2)], bad)) == 1 and len(benchmark.run_all([("a", 1), ("a", 2)], bad, True)) == 2


def test_runs_keep_what_they_said(tmp_path):
    import logging

    def train(m, s):
        for k in range(30):
            print(f"line {k}")
        logging.getLogger("x").warning("about to end")
        raise ValueError("no")

    out = benchmark.run_all([("a", 1)], train, logs=str(tmp_path / "logs"))
    assert len(out[0]["tail"]) == benchmark.TAIL and out[0]["tail"][-1] == "ValueError: no"
    said = (tmp_path / "logs" / "a__seed1.log").read_text()
    assert "line 0" in said and "about to end" in said


def test_yaml(tmp_path):
    (tmp_path / "model").mkdir()
    (tmp_path / "config.yaml").write_text("defaults:\n  - model: small\n  - _self_\n")
    (tmp_path / "model" / "small.yaml").write_text("lr: 2e-5\nlayers: [1, 2]\nname: x\nopt:\n  warm: 0.1\n  on: true\n")
    (tmp_path / "model" / "big.yaml").write_text("lr: 1\n")
    root, groups = config.load(str(tmp_path))
    assert root == {"model": "small"} and config.compose(root, groups) == {"model": {"lr": 2e-5, "layers": [1, 2], "name": "x", "opt": {"warm": 0.1, "on": True}}}
    assert config.compose(root, groups, ["model=big", "model.lr=3"]) == {"model": {"lr": 3}}


def test_dimensions(spark, tmp_path):
    import pytest

    (tmp_path / "sources.yaml").write_text("uno:\n  url: https://u\n  category: c\n  mode: direct\n  rss_feeds: [https://u/rss]\ndos: {url: https://d, mode: sitemap, url_filters: [/p/]}\n")
    rows = {r["name"]: r for r in dimensions.catalogue(spark, str(tmp_path / "sources.yaml")).collect()}
    assert rows["uno"]["rss_feeds"] == ["https://u/rss"] and rows["dos"]["url_filters"] == ["/p/"] and rows["dos"]["category"] is None and rows["dos"]["rss_feeds"] == []
    (tmp_path / "enc.json").write_text('{"a": "m/a", "b": "m/b"}')
    assert dimensions.encoders(str(tmp_path / "enc.json"), skip=["a"]) == {"b": "m/b"}
    with pytest.raises(KeyError):
        dimensions.encoders(str(tmp_path / "enc.json"), only=["z"])
    (tmp_path / "book.json").write_text(json.dumps({"axes": {a: {"definition": f"def {a}", "markers": ["m"]} for a in AXES}, "rules": ["r"]}))
    assert "def populismo" in pipelines.system_prompt(*dimensions.codebook(str(tmp_path / "book.json")))
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        dimensions.codebook(str(tmp_path / "bad.json"))


def test_sitemaps_and_pages(spark):
    import random
    import time

    index = "<sitemapindex xmlns='x'><sitemap><loc>b</loc></sitemap><sitemap><loc>c</loc></sitemap><sitemap><loc>a</loc></sitemap></sitemapindex>"
    maps = {"a": index, "b": "<urlset><url><loc>h/1</loc></url></urlset>", "c": "<urlset><url><loc>h/2</loc></url></urlset>"}
    assert feeds.sitemap_urls("a", maps.get) == ["h/1", "h/2"] and feeds.sitemap_urls("gone", maps.get) == []
    assert feeds.sitemap_urls("a", lambda a: time.sleep(5), seconds=0.2) == []
    s = feeds.Streak(random.Random(1))
    waits = [s.seen(ok) for ok in (True, False, False, True)]
    assert s.errors == 0 and waits[2] > waits[0] and waits[2] >= 4

    def fetch(u):
        if u == "slow":
            time.sleep(5)
        if u == "bad":
            raise OSError
        return f"<p>{u}</p>"

    got = feeds.fetch_pages(spark.createDataFrame([("a",), ("slow",), ("bad",), ("b",)], "url string").coalesce(1), fetch, seconds=0.3).collect()
    assert [r["html"] for r in got] == ["<p>a</p>", None, None, "<p>b</p>"]
    rules = feeds.robots_table(spark.createDataFrame([("h",), ("gone",), ("h",), (None,)], "host string"), lambda u: "User-agent: *\nDisallow: /p" if "//h/" in u else 1 / 0)
    assert sorted((r["host"], r["disallow"]) for r in rules.collect()) == [("gone", []), ("h", ["/p"])]
    df = spark.createDataFrame([(1, "https://h/p/1"), (2, "https://h/q"), (3, "https://other/p"), (4, None), (5, "https://h")], "i int, url string")
    assert sorted(r["i"] for r in jobs.robots_allowed(df, rules).collect()) == [2, 3, 4, 5]


def test_scrape_against_a_loop(spark):
    import hashlib
    import random

    r = random.Random(3)
    urls = [f"https://h/{k}" for k in range(60)]
    cand = [(s, r.choice(urls)) for s in ("a", "b", "c", "d") for _ in range(40)] + [("a", ""), ("b", None)]
    hashes = {u: r.choice([None] + [f"k{j}" for j in range(25)]) for u in urls}
    known = [("https://h/3", None), (None, "k4")]
    most = 5
    want, us, hs = [], {u for u, _ in known if u}, {h for _, h in known if h}
    for s in ("a", "b", "c", "d"):
        mine = sorted({u for x, u in cand if x == s and u}, key=lambda u: (hashlib.md5(f"42:{u}".encode()).hexdigest(), u))[: 2 * most]
        n = 0
        for u in mine:
            if n == most:
                break
            if u in us or u == "https://h/5" or hashes[u] is None or hashes[u] in hs:
                continue
            us.add(u)
            hs.add(hashes[u])
            want.append((s, u))
            n += 1
    df = lambda rows, c: spark.createDataFrame(rows, c)
    got = jobs.scrape(df(cand, "source string, url string"), df(known, "url string, content_hash string"), df([("h", ["/5"], ["/50", "/51", "/52", "/53", "/54", "/55", "/56", "/57", "/58", "/59"])], "host string, disallow array<string>, allow array<string>"), df(list(hashes.items()), "url string, content_hash string"), most)
    assert sorted((x["source"], x["url"]) for x in got.collect()) == sorted(want)


def test_train_and_compare(spark, tmp_path):
    import random

    r = random.Random(1)
    rows = [([x, r.random()], "train" if i % 5 else ("val" if i % 2 else "test"), int(x > 0.3), *[x] * 8) for i, x in ((i, r.random()) for i in range(120))]
    df = models.features(spark.createDataFrame(rows, "embedding array<double>, split string, is_political int, " + ", ".join(f"{a} double" for a in AXES)))
    out = str(tmp_path / "runs")
    m = jobs.train(df, out, "small", 7, regs=(10.0, 0.01, 1.0))
    assert m["model_name"] == "linear-0.01" and m["test_metrics"]["test/r2_populismo"] > 0.5 and m["test_metrics"]["test/politicity_accuracy"] > 0.7
    jobs.train(df, out, "other", 7, regs=(10.0,), smoke=True)
    ranked = jobs.compare(spark, out, str(tmp_path / "cmp")).where("axis = 'populismo'").orderBy("rank").collect()
    assert [x["encoder"] for x in ranked] == ["small", "other"]
    assert "| small |" in "\n".join(x["value"] for x in spark.read.text(str(tmp_path / "cmp" / "report.md")).collect()) and spark.read.option("header", True).csv(str(tmp_path / "cmp" / "metrics.csv")).count() == 16
    assert models.predict(models.load(m["best_checkpoint"]), df).count() == 120
    v = spark.createDataFrame([(["a", "b", "c"], [1.0, 2.0])], "n array<string>, v array<double>").select(jobs.named(F.col("n"), F.col("v"))).first()[0]
    assert v == {"a": 1.0, "b": 2.0} and "+00:00" in jobs.utc_now()


def test_answers_by_a_cursor(spark, tmp_path):
    src, good, dead, chk = (str(tmp_path / k) for k in ("s", "g", "d", "c"))
    parse = lambda b: b.withColumn("p", F.col("response").try_cast("int"))
    schema = "i int, response string"
    for k, batch in enumerate(([(1, "5"), (2, "x")], [(3, None), (4, "7")], [])):
        if batch:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.answered(incremental.source(spark, src, spark.createDataFrame([], schema).schema, "parquet"), parse, good, dead, chk)
        assert (spark.read.parquet(good).count(), spark.read.parquet(dead).count()) == [(1, 1), (2, 2), (2, 2)][k]
    incremental.answered(incremental.source(spark, src, spark.createDataFrame([], schema).schema, "parquet"), parse, good, dead, chk, force=True)
    assert sorted(r["p"] for r in spark.read.parquet(good).collect()) == [5, 7] and {r["response"] for r in spark.read.parquet(dead).collect()} == {"x", None}


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    import pytest

    from cribra import tables

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://h:7077"))
    with pytest.raises(ValueError):
        tables.shared_dir(bare)
    t = tables.materialize(spark.range(3), "gone")
    path = t.inputFiles()[0].rsplit("/", 1)[0]
    assert tables.path_exists(spark, path)
    tables.clear_scratch(spark)
    assert not tables.path_exists(spark, path) and tables.list_names(spark, path) == []


def test_jsonl_and_manifest(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text(json.dumps({"text": "ñ", "is_political": 1, "populismo": 0.5}) + "\n\n  \n" + json.dumps({"text": "b", "is_political": 0}) + "\n", encoding="utf-8")
    assert jsonl.line_counts(spark, str(p)) == (4, 2) and jsonl.read_labeled(spark, str(p)).count() == 1
    out = str(tmp_path / "o")
    df = jsonl.read(spark, str(p), jsonl.LABELED_ARTICLE)
    jsonl.write(df, out, dry=True)
    jsonl.write(df, out)
    jsonl.write(df, out)
    assert spark.read.text(out).count() == 4 and "ñ" in {r["text"] for r in jsonl.read(spark, out, jsonl.LABELED_ARTICLE).collect()}
    jsonl.write(df, out, force=True)
    assert spark.read.text(out).count() == 2 and jsonl.first_existing(spark, str(tmp_path / "no"), out) == out
    m = tmp_path / "m.json"
    m.write_text(manifest.dump({"train": [0, 2], "val": [1], "test": []}, "a", 42, 0.15, 0.15))
    assert sorted(tuple(r) for r in manifest.read(spark, str(m)).collect()) == [(0, "train"), (1, "val"), (2, "train")]
    run = tmp_path / "runs" / "enc__seed7"
    run.mkdir(parents=True)
    (run / "metrics.json").write_text(json.dumps({"encoder_alias": "z", "seed": 1, "test_metrics": {"test/r2_populismo": 0.5}}))
    r = jsonl.read_runs(spark, str(tmp_path / "runs")).first()
    assert (r["run"], r["encoder"], r["run_seed"], r["test_metrics"]) == ("enc__seed7", "enc", 7, {"test/r2_populismo": 0.5})


def test_jobs(spark):
    body = "El congreso discute la ley. " * 20
    pages = spark.createDataFrame([("https://h/a", f"<article><p>{body}</article>", "s", "c", "2025"), ("https://h/b", f"<article><p>{body}</article>", "s", "c", "2026"), ("https://h/c", "<p>corto", "s", "c", "2025")], "url string, html string, source string, category string, scraped_at string")
    art = pipelines.extract_articles(pages, spark.createDataFrame([], "url string, content_hash string"))
    assert [r["url"] for r in art.collect()] == ["https://h/a"]
    good, dead = pipelines.label_job(art, lambda: pipelines.KeywordJudge({"populismo": ("ley",)}))
    assert good.first()["populismo"] == 1.0 and dead.count() == 0
    good, dead = pipelines.label_job(art, lambda: (lambda texts: [None] * len(texts)))
    assert good.count() == 0 and dead.count() == 1
    out = pipelines.filter_job(art.unionByName(art.withColumn("text", F.lit("x"))), lambda: (lambda texts: ['{"is_article": false, "category": "otro", "reason": "r"}'] * len(texts)))
    assert sorted(r["outcome"] for r in out.collect()) == ["otro", "too_short_after_clean"]
    assert pipelines.clean_job(art.withColumn("url", F.lit("https://h/deportes/x"))).count() == 0
    p = pipelines.system_prompt({"populismo": {"definition": "d", "markers": ["m", "[TBD] x"], "examples_high": ["h"]}}, ["r"])
    assert "- m" in p and "TBD" not in p and "high: h" not in p


def test_tiers(spark):
    cat = spark.createDataFrame([("a", "sitemap", ["/p/"]), ("b", "direct", []), ("c", "sitemap", ["/p/"])], "name string, mode string, url_filters array<string>")
    feed = spark.createDataFrame([("a", "h/1", 0), ("a", "h/1", 1), ("a", "h/2", 2)], "source string, url string, ord int")
    site = spark.createDataFrame([("a", "h/p/3", 0), ("b", "h/4", 0), ("b", "h/4", 1)], "source string, url string, ord int")
    crawl = spark.createDataFrame([("c", "h/p/5", 0), ("c", "h/6", 1), ("b", "h/7", 0)], "source string, url string, ord int")
    assert sorted((r["url"], r["tier"]) for r in discovery.tiers(feed, site, crawl, cat, 1).collect()) == [("h/1", 0), ("h/2", 0), ("h/4", 1), ("h/4", 1), ("h/p/5", 2)]


def test_report_and_models(spark, tmp_path):
    s = evaluation.axis_summary(registry._values(spark))
    md = report.markdown(s, evaluation.encoder_summary(registry._runs(spark)))
    assert md.count("| populismo |") == 2 and "enc2" in md and report.radar_svg({"x": {"populismo": 50.0}}).count("<polygon") == 5
    assert report.bars(s, "r2").count() == 24
    df = spark.createDataFrame([([float(i), 1.0], *[i / 20] * 8) for i in range(20)], "embedding array<double>, " + ", ".join(f"{a} double" for a in AXES))
    m = models.fit(models.features(df))
    models.save(m, str(tmp_path / "m"))
    r = models.predict(models.load(str(tmp_path / "m")), models.features(df)).orderBy("populismo").collect()
    assert r[0]["axes"]["populismo"] < r[-1]["axes"]["populismo"] <= 100


def test_stream_restart(spark, tmp_path):
    src, out, chk = (str(tmp_path / k) for k in ("s", "o", "c"))
    rows = lambda a, b: spark.createDataFrame([(i, "x" * 300) for i in range(a, b)], "i int, text string")
    rows(0, 5).write.mode("append").json(src)
    for n in (5, 5, 8):
        incremental.append_once(incremental.clean(incremental.source(spark, src, rows(0, 1).schema)), out, chk)
        assert spark.read.parquet(out).count() == n
        if n == 5:
            done = spark.read.json(src).count()
            if done == 5 and n == 5 and not getattr(test_stream_restart, "again", False):
                test_stream_restart.again = True
            else:
                rows(5, 8).write.mode("append").json(src)


def test_stream_ledger(spark, tmp_path):
    src, led, chk, out = (str(tmp_path / k) for k in ("s", "l", "c", "o"))
    schema = "i int, url string, content_hash string"
    for batch in ([(1, "u", "h"), (2, "u", "g"), (3, "v", "h")], [(4, "u", "z"), (5, "w", "h"), (6, "y", "k")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(src)
        st = incremental.source(spark, src, spark.createDataFrame([], schema).schema)
        incremental.ledger_batches(st, led, chk, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), ["i"])
    assert sorted(r["i"] for r in spark.read.parquet(out).collect()) == [1, 6]
