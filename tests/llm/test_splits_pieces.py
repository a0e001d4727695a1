import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cribra.llm import pieces, splits
from cribra.llm.persons import persons

OUT = ("elfarodelsur", "fevaloresred", "radiomaranta", "elantiplano", "austral")


@pytest.mark.parametrize(
    "author,want",
    [
        ("Ana Ruiz", ["ana ruiz"]), ("  ANA\xa0RUIZ ", ["ana ruiz"]), ("Ruiz, Ana", ["ana ruiz"]), ("Ruiz Peña, Ana", ["ana ruiz pena"]), ("Por Ana Ruiz", ["ana ruiz"]), ("Ana Ruiz (corresponsal)", ["ana ruiz"]),
        ("Ana Ruiz | Enviado especial", ["ana ruiz"]), ("Ana Ruiz - Periodista", ["ana ruiz"]), ("Ana Ruiz, columnista", ["ana ruiz"]), ("Ana Ruiz y Leo Paz", ["ana ruiz", "leo paz"]), ("Ana Ruiz; Leo Paz", ["ana ruiz", "leo paz"]),
        ("Ana Ruiz / Leo Paz", ["ana ruiz", "leo paz"]), ("Ana Ruiz Gil, Leo Paz", ["ana ruiz gil", "leo paz"]), ("Redacción Política", []), ("Agencia Faro", []), ("Admin", []), ("", []), (None, []), ("El Faro del Sur", []), ("Fe y Valores en Red", []), ("Radio Maranta", []),
        ("Austral Veinticuatro", []), ("El Montañero", []), ("Ana", []), ("Colaborador invitado", []), ("Unidad de datos", []),
    ],
)
def test_persons(author, want):
    assert persons(author, OUT) == want


SCHEMA = "article_id long, source string, authors array<string>"


def test_splits(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "b", "c", "d", None]), r.choice([None, [], [None, ""], ["Redacción"], [f"Ana Ruiz{chr(97 + r.randrange(20))}"]])) for i in range(300)] + [(900, "a", ["Leo Paz"]), (901, None, ["Leo Paz", "Eva Gil"]), (902, "z", ["Eva Gil"])]
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = splits.record_nodes(df, ())
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s, a in rows:
        keys = ([f"s:{s}"] if s else []) + [f"p:{p}" for x in a or [] for p in persons(x)] or [f"a:{i}"]
        for k in keys:
            x, y = find(keys[0]), find(k)
            parent[max(x, y)] = min(x, y)
    table = splits.ComponentTable(spark)
    got = {q["article_id"]: (q["component"], q["split"]) for q in table.run(nodes).collect()}
    assert len(got) == len(rows)
    by = {}
    for i, s, a in rows:
        keys = ([f"s:{s}"] if s else []) + [f"p:{p}" for x in a or [] for p in persons(x)] or [f"a:{i}"]
        assert got[i][0] == find(keys[0])
        by.setdefault(got[i][0], set()).add(got[i][1])
    assert all(len(v) == 1 for v in by.values())
    pairs = {tuple(x) for x in splits.linked_sources(table.read()).collect()}
    names = sorted({s for _, s, _ in rows if s})
    assert pairs == {(x, y) for x in names for y in names if x < y and find(f"s:{x}") == find(f"s:{y}")} and ("a", "z") in pairs


def test_merges_keep_or_quarantine(spark):
    t = splits.ComponentTable(spark)
    first = [(i, f"s{i % 8}", None) for i in range(80)]
    old = {r["article_id"]: r["split"] for r in t.run(splits.record_nodes(spark.createDataFrame(first, SCHEMA), ())).collect()}
    other = next(i for i in range(8) if old[i] != old[0])
    new = [(100, "s0", ["Ana Ruiz"]), (101, f"s{other}", ["Ana Ruiz"]), (102, "s9", None), (103, "s1", ["Leo Paz"] if other != 1 else None)]
    got = {r["article_id"]: r["split"] for r in t.run(splits.record_nodes(spark.createDataFrame(new, SCHEMA), ())).collect()}
    assert got[100] == got[101] == "quarantine" and got[102] in splits.SHARES and (other == 1 or got[103] == old[1])


def test_empty_splits(spark):
    n = splits.record_nodes(spark.createDataFrame([], SCHEMA), ())
    table = splits.ComponentTable(spark)
    assert table.read() is None and table.run(n).count() == 0 and splits.linked_sources(table.read()).count() == 0


def test_increments_give_the_components_of_all(spark):
    """A table reopened for each increment ends with the components that one run over everything finds."""
    r = random.Random(9)
    rows = [(i, r.choice(["a", "b", "c", "d", "e", "f", None]), [f"Ana Ruiz{chr(97 + r.randrange(26))}"] if r.random() < 0.2 else None) for i in range(60)]
    path = splits.ComponentTable(spark).path
    given = {}
    for k in range(0, 60, 20):
        t = splits.ComponentTable(spark, path)
        got = {x["article_id"]: x["split"] for x in t.run(splits.record_nodes(spark.createDataFrame(rows[k : k + 20], SCHEMA), ())).collect()}
        assert len(got) == 20 and t.version() == k // 20 + 1
        given |= got
    whole = splits.components_of(splits.record_nodes(spark.createDataFrame(rows, SCHEMA), ()))
    assert {(x["node"], x["component"]) for x in splits.ComponentTable(spark, path).read().collect()} == {tuple(x) for x in whole.collect()}
    # records of one source keep their split from increment to increment, unless a merge of different ones holds them back
    for s in "abcdef":
        assert len({given[i] for i, x, _ in rows if x == s} - {"quarantine"}) <= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["Una frase corta. ", "palabra", " ", "\n", "\n\n", "ñandú, ", "¿Qué? ", "x" * 40]), max_size=400).map("".join))
def test_pieces_cover_and_fit(text):
    spans = pieces.cut(text, limit=200, overlap=30)
    assert all(0 < b - a <= 200 for a, b in spans)
    if text:
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and (len(spans) == 1) == (len(text) <= 200)
        assert all(p[0] < q[0] <= p[1] < q[1] for p, q in zip(spans, spans[1:]))
    else:
        assert spans == []


def test_the_overlap_must_be_less_than_the_limit():
    for overlap in (300, 301, -1):
        with pytest.raises(ValueError):
            pieces.cut("x" * 1000, limit=300, overlap=overlap)
    assert pieces.cut("x" * 1000, limit=300, overlap=299)[-1][1] == 1000


def test_time_grows_with_the_text():
    import time

    took = []
    for n in (2000, 16000):
        text = "".join(f"Frase {k % 97} de la junta {k % 13}. " for k in range(n))
        began = time.process_time()
        pieces.cut(text)
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0]


def test_cohesion_and_depths_against_plain_sums():
    r = random.Random(4)
    text = " ".join(f"{' '.join(r.choice(['puerto', 'riego', 'mercado', 'camino']) for _ in range(r.randrange(1, 6)))}." for _ in range(60))
    ends = pieces._ends(text)
    sims = pieces._cohesion(text, ends, 3)
    cuts = [0, *(e for e, _ in ends), len(text)]
    sents = [text[a:b].replace(".", "").split() for a, b in zip(cuts, cuts[1:])]
    for i in range(len(ends)):
        a, b = (Counter(w for s in x for w in s) for x in (sents[max(0, i - 2) : i + 1], sents[i + 1 : i + 4]))
        norm = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
        assert abs(sims[i] - (sum(a[w] * b[w] for w in a) / norm if norm else 0)) < 1e-12
    depth = pieces._depths(sims)
    for i, s in enumerate(sims):
        total = 0
        for side in (sims[:i][::-1], sims[i + 1 :]):
            peak = s
            for x in side:
                if x < peak:
                    break
                peak = x
            total += peak - s
        assert abs(depth[i] - total) < 1e-12


def test_natural_cuts(spark):
    text = "\n".join(" ".join(f"La junta {k} habla del {w} con el {w} y el {w} otra vez." for k in range(8)) for w in ("puerto", "riego", "mercado", "camino", "censo", "archivo", "molino", "faro", "huerto", "teatro"))
    spans = pieces.cut(text)
    assert len(spans) > 1 and all(text[b - 1] in " \n" and text[:b].rstrip()[-1] == "." for _, b in spans[:-1])
    assert all(200 <= p[1] - q[0] <= 400 for p, q in zip(spans, spans[1:]))
    assert pieces.cut("x" * 7000)[0] == (0, 3000)
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "corto")], "article_id long, text string").withColumn("piece", pieces_col())
    got = pieces.pieces(df).collect()
    assert {r["article_id"] for r in got} == {1, 4} and max(r["n_chars"] for r in got) <= 3000


def pieces_col():
    from pyspark.sql import functions as F

    return F.lit("clash")
