import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cribra.llm import news, quality, rulelist, standing_lines, wrappers
from cribra.llm.quality_seeds import labelled

NEWS = "article_id long, text string, url string, source string"


def name(r):
    return "".join(r.choice("bcdlmnrst") + r.choice("aeiou") for _ in range(4))


def prose(r, n=3):
    return " ".join(f"El grupo de {name(r)} presentó ayer con {name(r)} el plan número {r.randrange(10**6)} ante la junta de {name(r)} y los vecinos del valle." for _ in range(n))


def pages(n=40, seed=1):
    r, out, truth = random.Random(seed), [], []
    for i in range(n):
        lines = [("Inicio > Nación", 1), (f"Hace {r.randrange(9)} horas", 1), (f"Por: Ana{chr(97 + i % 26)} Ruiz{chr(97 + i // 26)}", 1), (prose(r), 0), ("", None), (f"Lea también: El plan {name(r)} sigue en pie", 1), (prose(r), 0), (random.Random(i).choice(["La cuenta", "Un giro", "Lo que sigue", "El costo", "Otra voz"] + [f"Sub{chr(97 + k)} título" for k in range(26)] * 3), 0), (prose(r), 0), ("Lo más visto", 1), (f"La junta aprobó el asunto {name(r)} en el valle", 1), (f"¿Por qué el asunto {name(r)} importa a los vecinos?", 1), ("© 2024 El Sitio. Todos los derechos reservados.", 1)]
        out.append((i, "\n".join(x for x, _ in lines), f"https://www.sitio.example/{i}", "sitio"))
        truth += [(i, k) for k, (_, m) in enumerate(lines) if m]
    return out, set(truth)


def test_wrapper_lines(spark):
    rows, truth = pages()
    rows += [(900, None, None, None), (901, "", "https://www.sitio.example/x", None), (902, "\n".join(f"- Persona {k}" for k in range(30)) + "\n© 2024 El Sitio. Todos los derechos reservados.", "https://www.sitio.example/y", "sitio")]
    df = spark.createDataFrame(rows, NEWS)
    got = {tuple(r) for r in news.wrapper_lines(df).collect()}
    assert got == truth
    assert {r[0] for r in news.no_prose(df).collect()} == {900, 901, 902}
    b = {r["article_id"]: r["body"] for r in news.bodies(df).collect()}
    assert "Lo más visto" not in b[0] and b[900] == "" and len(b) == len(rows)


def test_wrappers_met_by_site_equal_those_sent(spark, monkeypatch):
    df = spark.createDataFrame(pages(12)[0] + [(700, "Sin sitio\nLo más visto", None, None), (701, "Inicio > Nación", "https://otro.example/1", "otro")], NEWS)
    p = wrappers.pages_of(df)
    w = wrappers.learn_tokens(p)
    lines = lambda: sorted(map(tuple, wrappers.split_body(p, w).select("article_id", F.array_join("furniture", ","), "body").collect()))
    a = lines()
    monkeypatch.setattr(wrappers, "SEND_BYTES", -1)
    monkeypatch.setattr(wrappers, "SITE_PAGES", 5)
    assert lines() == a and len(a) == 14


def test_a_line_is_template_only_where_the_template_has_it(spark):
    """The closing line of every page stands between the paragraphs of one page: there it is body."""
    rows, truth = pages(60)
    r = random.Random(5)
    odd = [(950, "\n".join(["Inicio > Nación", prose(r), "Lo más visto", prose(r), prose(r), "© 2024 El Sitio. Todos los derechos reservados."]), "https://www.sitio.example/odd", "sitio")]
    got = {tuple(x) for x in news.wrapper_lines(spark.createDataFrame(rows + odd, NEWS)).collect()}
    assert got == truth | {(950, 0), (950, 5)}
    body = {x["article_id"]: x["body"] for x in news.bodies(spark.createDataFrame(rows + odd, NEWS)).collect()}[950]
    assert body.split("\n")[1] == "Lo más visto" and len(body.split("\n")) == 4


def test_expressions():
    e = wrappers.Expression()
    for page in ([1, 2, 3], [1, 3], [1, 4, 3], [2, 2, 3]):
        e.absorb(page)
    assert [sorted(g) for g in e.groups] == [[1], [4], [2], [3]] or [sorted(g) for g in e.groups] == [[1], [2], [4], [3]]
    e.absorb([3, 1])  # against the order: what lies between becomes one group
    assert [sorted(g) for g in e.groups] == [[1, 2, 3, 4]]
    assert e.groups[0] == {1: 4, 2: 2, 3: 5, 4: 1}
    f = wrappers.Expression()
    f.absorb([5, 1])
    f.merge(e.groups)
    assert [sorted(g) for g in f.groups] == [[5], [1, 2, 3, 4]]


@pytest.mark.parametrize("pages_", [[[1, 2, 3], [2, 3, 1], [4]], [[1, 2], [3, 4], [2, 5, 3], [4, 6]], [[7, 8, 9], [9, 10], [8, 11, 9], [10, 12], [12, 7]]])
def test_an_expression_takes_every_page_it_was_inferred_from(pages_):
    whole, left, right = wrappers.Expression(), wrappers.Expression(), wrappers.Expression()
    for k, p in enumerate(pages_):
        whole.absorb(p)
        (left if k % 2 else right).absorb(p)
    left.merge(right.groups)
    for e in (whole, left):
        places = {wrappers.BEFORE: {t: i for i, g in enumerate(e.groups) for t in g}}
        for p in pages_:
            assert all(wrappers.match([(wrappers.BEFORE, wrappers.BEFORE, t) for t in p], places))


def test_sites(spark):
    cases = [("https://www.eltiempo.com.co/a", "eltiempo"), ("https://a.gov.co", "a"), ("http://m.sitio.example:80/x", "sitio"), ("https://u:p@b.c.sitio.co/x", "sitio"), ("https://sitio.co.uk", "sitio"), ("HTTPS://Co.Example", "co"), ("no url", "fuente"), (None, "fuente"), ("https://localhost/x", "fuente")]
    df = spark.createDataFrame([(u, " Fuente ") for u, _ in cases], "url string, source string")
    assert [x[0] for x in df.select(wrappers.site_column()).collect()] == [w for _, w in cases]


def test_empty_tables(spark):
    e = spark.createDataFrame([], NEWS)
    assert news.wrapper_lines(e).count() == 0 and news.no_prose(e).count() == 0 and standing_lines.standing_lines(e).count() == 0


def test_statistics(spark):
    df = spark.createDataFrame([("La ley, «hoy».\n\n- 12 ab\n",), ("",), (None,), ("x" * 100_000,)], "body string").withColumn("words", F.lit("clash"))
    r = quality.with_stats(df).collect()
    assert (r[0]["words"], r[0]["lines"], r[0]["end_punct_share"]) == (5, 2, 0.5) and abs(r[0]["digit_share"] - 2 / 12) < 1e-9 and r[0]["common_share"] == 0.2
    assert [r[i]["words"] for i in (1, 2, 3)] == [0, 0, 1] and r[1]["symbol_ratio"] == 0.0 and r[3]["mean_word_len"] == 100_000


def test_rules_on_held_out_documents(spark):
    spark.range(1).count()
    docs = labelled(400, seed=99)
    got = quality.flag_no_prose(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(docs)], "i int, body string")).select("i", "no_prose").collect()
    right = sum(r["no_prose"] == (docs[r["i"]][1] == 1) for r in got)
    assert right / len(docs) > 0.93


def test_rule_list():
    x = {"a": np.arange(600.0) % 61, "b": np.tile([0.0, 1.0], 300)}
    y = (x["a"] > 40) & (x["b"] > 0)
    rules = rulelist.induce(x, y)
    m = np.zeros(600, bool)
    for r in rules:
        m |= rulelist.covers(r, x)
    assert (m == y).mean() > 0.95 and rulelist.to_case(rules).startswith("CASE WHEN") and rulelist.to_case([]) == "0"
    assert rulelist.induce(x, np.zeros(600, bool)) == []


def forms(line):
    return "".join(c for c in line.lower() if c.isalpha())


def test_standing_lines_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, "\n".join(r.choice(["Aviso legal 12", "aviso, LEGAL", "Comparte", "", "--", f"frase {chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}", "Pie\r"]) for _ in range(r.randrange(9))), r.choice(["a", "a", "a", "b", None]), "clash") for i in range(120)] + [(500, None, "a", "x")]
    df = spark.createDataFrame(rows, "article_id long, text string, source string, form string")
    count, n = {}, {}
    for _, t, s, _ in rows:
        if s:
            n[s] = n.get(s, 0) + 1
            for f in {forms(x) for x in (t or "").split("\n")} - {""}:
                count[s, f] = count.get((s, f), 0) + 1
    want = {(i, k) for i, t, s, _ in rows if s for k, x in enumerate((t or "").split("\n")) if forms(x) and count[s, forms(x)] >= max(5, 0.03 * n[s])}
    got = standing_lines.standing_lines(df)
    assert {(g["article_id"], g["line_no"]) for g in got.collect()} == want
    cleaned = {g["article_id"]: g["text"] for g in standing_lines.without_standing_lines(df, got).collect()}
    assert all(cleaned[i] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in want)) for i, t, _, _ in rows)


@pytest.mark.parametrize("line", ["", " \t", "\xa0", "123", "#a #b", "x" * 5000, "Etiquetas: a, b, c", "«»", "\ud83d", "a," * 150, "," * 300, "1,2,3," * 60, "data:image/png;base64,AAAA,BBBB" + "x" * 300])
def test_line_info_takes_anything(line):
    wrappers.line_info(line)


def test_forms_of_lines_hold_their_letters(monkeypatch):
    lines = ["¿Qué dijo la niña? «Nada»", "a_b ½ 7² ٣ x", "Uno — dos…", "e\u0301l \u2028 \x85 y", "12 de enero de 2024", "汉字 ΑΣ İ"]
    for x in lines:
        low = x.strip(wrappers._EDGE).lower()
        letters = wrappers._NON_LETTER.sub("", wrappers._MONTH.sub("", low))
        assert wrappers.line_info(x)[0] == wrappers._h("form", letters)
    monkeypatch.setattr(wrappers, "_NON_LETTER", None)  # letters alone need no search for others
    assert wrappers.line_info("La niña comió, y 7 más.")[0] == wrappers._h("form", "laniñacomióymás")


def test_blocks(spark):
    rows = [(i, "Aviso legal\nComparte\n" + f"cuerpo {chr(97 + i)}\nPie", "a") for i in range(20)]
    got = standing_lines.blocks(spark.createDataFrame(rows, "article_id long, text string, source string")).collect()
    assert sorted((r["forms"], r["lines"], r["docs"]) for r in got) == [(1, 20, 20), (2, 40, 20)]


def test_a_filter_on_no_prose_tokenises_once(spark):
    df = quality.flag_no_prose(spark.createDataFrame([("Una frase.",), ("",), (None,)], "body string"))
    for f in ("NOT no_prose", "no_prose"):
        assert df.where(f).select("body")._jdf.queryExecution().optimizedPlan().toString().count("split(lower(") == 1


def test_ends_of_lines(spark):
    lines = ["Fin.", "Fin", "a.b", "«Fin.»", "Fin.)  ", "Fin.\r", "a Fin.", "Fin. ", "Fin. b", "a.\rb", "Fin.\x85", ".", "Fin…\"']", "..a", "Fin.\xa0"]
    old = spark.createDataFrame([(x,) for x in lines], "body string").select("body", F.col("body").rlike(r"[.!?…:][\s»”\"')\]]*$").alias("ends"))
    assert [(r["body"], r["end_punct_share"] == 1) for r in quality.with_stats(old).collect()] == [(r["body"], r["ends"]) for r in old.collect()]
