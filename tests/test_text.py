"""The cleaner against independent expectations in Python's re."""

import os
import re
import subprocess
import sys

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cribra.functions import text, urls
from cribra.functions.patterns import STEPS, spell
from cribra.plans import registry

CASES = [
    ("C0", "Menú\nNoticia \nCuerpo", "Cuerpo"),
    ("C0", "Noticia\nCuerpo", "Noticia\nCuerpo"),
    ("C0", "a\nNoticia\nb\nAnálisis\nc", "b\nAnálisis\nc"),
    ("C1", "x En este portal utilizamos datos de navegación bla\nbla aquí y", "x  y"),
    ("C2", "a\nPUEDE CONOCER CÓMO DESHABILITARLAS U OBTENER MÁS INFORMACIÓN\n aquí \nb", "a\nb"),
    ("C3", "a\n  ACEPTAR Y CONTINUAR \nb", "a\nb"),
    ("C3", "a\nPOLÍTICA DE PRIVACIDAD\nb", "a\n\nb"),
    ("C4", "x\nAdquiere el plan de suscripción hoy\ny", "x\n\ny"),
    ("C5", "x\nError 404 \nno está\ny", "x\n\ny"),
    ("C6", "a\nLea también\n\n" + "t" * 200 + "\nb", "a\nb"),
    ("C6", "a\nLea también\n\n" + "t" * 201 + "\nb", "a\nt\nb"),
    ("C7", "Lea: esto", "esto"),
    ("C8", "a\nSÍGUENOS EN WHATSAPP ya\nb", "a\nb"),
    ("C9", "a\nJUAN PÉREZ GÓMEZ\nPeriodista de Cultura\nb", "a\nb"),
    ("C9", "a\nRedacción Nación\nb", "a\nb"),
    ("C10", "a\n  x.y@mail.example.co \nb", "a\nb"),
    ("C11", "a\nSEMANA\nb", "a\nb"),
    ("C12", "a\nTendencias de hoy\nresto\nfin", "a"),
    ("C14", "a \t\nb ", "a\nb"),
    ("C15", "a\n\n\n\nb", "a\n\nb"),
]


@pytest.mark.parametrize("step,given,want", CASES)
def test_step(spark, step, given, want):
    from cribra.functions.patterns import AFTER_AUTHORS

    st = [s for s in (*STEPS, *AFTER_AUTHORS) if s[0] == step]
    got = spark.createDataFrame([(given,)], "t string").select(text.apply_steps(F.col("t"), st)).first()[0]
    assert re.sub(r"\n+", "\n", got) == re.sub(r"\n+", "\n", want)  # blank lines are the business of C15
    if step in ("C15", "C6", "C0"):
        assert got == want


def test_chain_is_what_re_gives(spark):
    def py(t):
        for _, flags, p, r, once in STEPS:
            f = 0
            for k, v in (("i", re.I), ("m", re.M), ("s", re.S)):
                f |= v if k in flags else 0
            t = re.sub(p.replace(r"\z", r"\Z"), r, t, count=1 if once else 0, flags=f)
        t = re.sub(r"[ \t]+$", "", t, flags=re.M)
        return re.sub(r"\n{3,}", "\n\n", t).strip()

    given = ["\n".join([c[1] for c in CASES[i:]]) for i in range(len(CASES))] + [c[1] for c in CASES] + ["", " \xa0\n ", "a\r\nACEPTAR\r\nb", "x y z", "🙂 ñ" * 50]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, t string").select("i", text.clean_article(F.col("t")).alias("c")).collect()
    assert {r["i"]: r["c"] for r in rows} == {i: py(g) for i, g in enumerate(given)}


def test_authors_and_small_functions(spark):
    df = spark.createDataFrame([("a\n  ANA RUIZ \n\nb", ["Ana Ruiz ", "", None]), ("a\nAna Ruiz", None), ("a\nx", [])], "t string, a array<string>")
    assert [r[0] for r in df.select(text.without_author_lines(F.col("t"), F.col("a"))).collect()] == ["a\n\nb", "a\nAna Ruiz", "a\nx"]
    one = spark.createDataFrame([(" a ; ;b", "x" * 91, "x" * 90, None)], "a string, l string, k string, n string")
    r = one.select(text.split_authors(F.col("a")), text.ellipsis(F.col("l")), text.ellipsis(F.col("k")), text.split_authors(F.col("n")), text.clean_article(F.col("n"))).first()
    assert list(r) == [["a", "b"], "x" * 87 + "...", "x" * 90, [], None]


def test_clean_column_is_computed_once(spark):
    df = text.barrier(spark.createDataFrame([("x",)], "text string"), "c", text.clean_article(F.col("text"))).where("length(c) > 0").select("c", F.length("c"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Periodista") == 1


@pytest.mark.parametrize("url,want", [("https://h", "root"), ("https://h/", "root"), ("https://h//A/b", "a"), ("https://h/Ab?x=/y", "ab"), ("https://h/?q", "root"), ("https://h/a#b/c", "a"), ("deportes/x", "deportes"), ("https://h/a b/c", "a b"), (None, "root"), ("palabra", "palabra")])
def test_section(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(urls.url_section(F.col("u"))).first()[0] == want


def test_filters_and_robots(spark):
    df = spark.createDataFrame([("https://h/Politica/x", ["/politica/"]), ("https://h/x", ["/y/"]), ("https://h/x", []), ("https://h/x", None), (None, ["a"])], "u string, f array<string>")
    assert [r[0] for r in df.select(urls.passes_filters(F.col("u"), F.col("f"))).collect()] == [True, False, True, True, False]
    r = spark.createDataFrame([("/a/b", ["/a"], ["/a/b"]), ("/a", ["/a"], []), ("/c", ["/a"], []), ("/c", None, None)], "p string, d array<string>, a array<string>")
    assert [x[0] for x in r.select(urls.robots_allows(F.col("p"), F.col("d"), F.coalesce("a", F.array().cast("array<string>")))).collect()] == [True, False, True, True]


def test_dialects():
    assert spell(r"[\w.]+\s", "m", "java") == r"(?dUm)[\p{L}\p{N}_.]+[\s\x1c-\x1f]"
    assert spell(r"\d", "i", "re2") == r"(?i)[\p{Nd}]"


def test_allowlist_as_a_sessions_first_query(tmp_path):
    rows = [(1, "https://h/P/x", "a"), (2, "https://h/q", "a"), (3, "https://h/q", "b"), (4, None, "a"), (5, "https://h/q", "c"), (6, "https://h/q", "d"), (7, "https://h/q", "e"), (8, "https://h/p/", "f"), (9, "https://h/p/", None)]
    cat = [("a", "sitemap", ["/p/"]), ("b", "direct", ["/p/"]), ("c", "sitemap", []), ("d", "sitemap", None), ("e", "sitemap", ["/z/", None, "/Q"]), ("f", None, [None])]
    pq.write_table(pa.table(dict(zip(("scrape_id", "url", "source"), map(list, zip(*rows)))), pa.schema([("scrape_id", pa.int64()), ("url", pa.string()), ("source", pa.string())])), tmp_path / "scraped_urls.parquet")
    pq.write_table(pa.table(dict(zip(("name", "mode", "url_filters"), map(list, zip(*cat)))), pa.schema([("name", pa.string()), ("mode", pa.string()), ("url_filters", pa.list_(pa.string()))])), tmp_path / "sources.parquet")
    code = f"""from pyspark.sql import SparkSession
import __spark_entry__ as e
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
print("ids", sorted(r["scrape_id"] for r in e.queries()["url_allowlist"](s, {str(tmp_path)!r}).collect()))"""
    said = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, timeout=300)
    con = duckdb.connect()
    for t in ("scraped_urls", "sources"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = sorted(x[0] for x in con.execute(registry.oracle_sql()["url_allowlist"]).fetchall())
    assert f"ids {want}" in said.stdout.splitlines() and 2 < len(want) < len(rows), said.stderr[-2000:]
