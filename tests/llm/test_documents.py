import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cribra.llm import mixing, packing, truncation
from cribra.llm.tokens import DEFAULT_VOCABULARY, Tokens

TEXTS = ["", " ", "a", "Hola, mundo.", "dos  espacios", "línea\n\notra línea \n", " delante", "🙂🙂 emoji ñandú", "tab\tx", "1.234,5 €", "x" * 3000, "fin \r\n b", "a\xa0b c d"]


@pytest.fixture(scope="module")
def tok():
    return Tokens()


def test_counts_are_exact(tok):
    import glob

    import pyarrow.parquet as pq

    more = []
    for f in glob.glob("/root/testdata/sf0.001/documents.parquet"):
        more = pq.read_table(f).column("text").to_pylist()
    for t in TEXTS + more:
        assert tok.count(t) == len(tok.encode(t))
    assert tok.count(None) == 0


@pytest.mark.parametrize("most", [1, 3, 50])
def test_spans_cover(tok, most):
    for t in TEXTS:
        spans = tok.spans(t, most)
        assert "".join(t[a:b] for a, b, _ in spans) == t and (most < 3 or all(n <= most for *_, n in spans))


def test_spans_encode_only_words_in_which_a_part_ends(tok, monkeypatch):
    r, encoded = random.Random(4), []
    encode = tok.encode
    texts = [" ".join(r.choice(["palabra", "ñandú", "🙂🙂", "el", "censo", "1.234,5", "x" * 40, "ya\nno", "ΑΣ"]) for _ in range(600)) for _ in range(20)]
    monkeypatch.setattr(tok, "encode", lambda t: encoded.append(t) or encode(t))
    for t in texts:
        ids, want = encode(t), []
        while ids:  # the most tokens that end at a code point
            raw = [tok.bpe.decode_bytes(ids[:k]) for k in range(1, 51)]
            k = max(k for k in range(1, 51) if raw[k - 1].decode("utf-8", "replace").encode() == raw[k - 1])
            want.append(tok.bpe.decode(ids[:k]))
            ids = ids[k:]
        encoded.clear()
        assert [t[a:b] for a, b, _ in tok.spans(t, 50)] == want
        assert sum(map(len, encoded)) < 0.5 * len(t)


def test_terms_of_an_item_by_its_words_between_blanks(spark):
    texts = ["uno Dos uno-dos, 3 tres_uno", " ΑΣ ΑΣ. Ασ ", "a\nb  a\tb İ i̇", "7 8 9"]
    got = packing.items(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    plain = [Counter(packing.zlib.crc32(w.encode()) & 0x7FFFFFFF for w in packing._TERM.findall(t.lower())) for t in texts]
    assert {r["doc_id"]: dict(zip(np.frombuffer(r["terms"], np.int32).tolist(), np.frombuffer(r["times"], np.int32).tolist())) for r in got} == dict(enumerate(plain))


def test_packing(spark, tok):
    r = random.Random(1)
    words = [w * 2 for w in ("puerto", "riego", "mercado", "camino", "censo", "archivo")]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([3, 20, 60, 90, 400])))) for i in range(150)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash"))
    got = packing.pack(df, 128).collect()
    box, doc = {}, {}
    for g in got:
        box[g["container"]] = box.get(g["container"], 0) + g["tokens"]
        doc.setdefault(g["doc_id"], []).append((g["part"], g["start"], g["n_chars"]))
    assert max(box.values()) <= 128 and set(doc) == set(range(150)) and sum(box.values()) / (128 * len(box)) > 0.95
    for i, t in rows[:150]:
        assert "".join(t[s : s + n] for _, s, n in sorted(doc[i])) == t and (len(doc[i]) == 1) == (tok.count(t) <= 128)
    assert packing.pack(df.where("doc_id >= 900"), 128).count() == 0 and packing.pack(df.limit(0), 128).count() == 0


def test_shards_bring_related_items_together(spark, monkeypatch):
    """Items of twenty topics, many more than a shard holds: containers hold one topic far more often than by chance."""
    r = random.Random(7)
    topics = [[f"t{k}w{j}".translate(str.maketrans("0123456789", "abcdefghij")) for j in range(12)] for k in range(20)]
    rows = [(i, " ".join(r.choice(topics[i % 20]) if r.random() < 0.5 else r.choice(["de", "la", "en", "con", "por"]) for _ in range(r.randrange(10, 40)))) for i in range(800)]
    monkeypatch.setattr(packing, "SHARD_ITEMS", 200)
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), 256)
    rep = packing.report(out, 256).first()
    assert rep["items"] == 800 and rep["fill"] > 0.9 and rep["shared"] > 1.15 * rep["other"]
    boxes = {}
    for x in out.collect():
        boxes.setdefault(x["container"], []).append(x["doc_id"] % 20)
    same = sum(b.count(k) * (b.count(k) - 1) for b in boxes.values() for k in set(b)) / sum(len(b) * (len(b) - 1) for b in boxes.values())
    assert same > 0.2  # by chance 0.05


def test_scores_against_plain_bm25():
    r = random.Random(3)
    docs = [Counter(r.choice("abcdefghijklmnop") for _ in range(r.randrange(1, 30))) for _ in range(40)]
    terms = [np.array([ord(w) for w in d], np.int32) for d in docs]
    index = packing._Index(terms, [np.array(list(d.values()), np.int32) for d in docs])
    mean = sum(sum(d.values()) for d in docs) / len(docs)
    df = Counter(w for d in docs for w in d)
    used = np.zeros(len(docs), bool)
    for seed in range(len(docs)):
        want = [sum(math.log(1 + (40 - df[w] + 0.5) / (df[w] + 0.5)) * d[w] * (packing.K1 + 1) / (d[w] + packing.K1 * (1 - packing.B + packing.B * sum(d.values()) / mean)) for w in docs[seed] if w in d) for d in docs]
        got = index.score(seed)
        assert np.allclose(got[~used], np.array(want)[~used], atol=1e-4)
        used[seed] = True
        index.keep(~used)


def test_mixing(spark):
    r = random.Random(2)
    rows = [(i, s, " ".join("palabra" for _ in range(r.randrange(5, 60)))) for i, s in enumerate(["a"] * 300 + ["b"] * 40 + ["c"] * 100 + ["d"] * 9 + [None] * 3)] + [(999, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("tokens", F.lit("clash"))
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("gone", 0.0, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(df, t, block=64)
    got = {x["source"]: x for x in mixing.shares(m, t).collect()}
    assert all(abs(got[s]["share"] - w) < 0.02 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2))) and got["gone"]["share"] == 0
    uses = m.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("repeat").alias("k")).collect()
    most = {"a": 1, "b": 3, "c": 2}
    assert all(u["n"] == u["k"] <= most[u["source"]] for u in uses)
    half = m.where(F.col("slot") < m.agg(F.max("slot")).first()[0] / 2)
    assert abs(half.where("source = 'a'").agg(F.sum("tokens")).first()[0] / half.agg(F.sum("tokens")).first()[0] - 0.5) < 0.08
    assert mixing.mix(df.limit(0), t).count() == 0 and mixing.mix(df, t, total=10**9).where("source = 'c'").agg(F.max("repeat")).first()[0] == 1


def prose(r):
    return " ".join(f"{r.choice(['El puerto', 'La junta', 'Un grupo'])} {r.choice(['aprobó', 'discutió', 'aplazó'])} {r.choice(['el plan de riego', 'la venta del mercado'])} {r.choice(['con reparos', 'sin detalles', 'de nuevo'])}." for _ in range(r.randrange(4, 9)))


def test_truncation(spark):
    r, rows, cut = random.Random(3), [], set()
    for i in range(700):
        t = prose(r)
        if i % 7 == 0:
            t += r.choice(["\nFuente: el archivo", f"\nAna {chr(65 + r.randrange(20))}uiz", "\nhttps://h.example/x1"])
        if i % 20 == 3:
            t = t[: len(t) // 2]
            while t[-1] in ". ":
                t = t[:-1]
            cut.add(i)
        if i % 100 == 5:
            t += r.choice([" y [...]", " y…", " y &nb", " y �"])
            cut.add(i)
        rows.append((i, t, r.choice(["es", "ES", None, "es-CO"]), "s"))
    rows += [(900, None, None, None), (901, "", "es", None), (902, "  ", "pt", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("odds", F.lit("clash"))
    flags = truncation.truncated(df)
    got = {x["doc_id"] for x in flags.where("cut").collect()}
    assert len(got & cut) / len(cut) > 0.9 and len(got - cut) <= 8 and flags.count() == 700
    share = {x["source"]: x["cut"] for x in truncation.truncated_share(df, flags).collect()}
    assert share == {"s": len(got)}
    assert truncation.truncated(df.limit(0)).count() == 0


def test_normal_form():
    texts = ["La ministra Perla llevó 537.226 a EE. UU.  \n\n https://a.example/x1 ", "  ", "Fin.\nTemas: nómina oficial, mapa", "", "a", "X #hola  b\r\n", "m1@x.example"]
    codes, ends = truncation.normal_codes(texts)
    parts = [p for p in "".join(map(chr, codes)).split("\0") if p]
    assert parts == ["A ministra A llevó 9 a A. A.\nU", "A.\nA: L", "a", "A # b", "E"]
    assert [chr(codes[e]) for e in ends] == ["U", "\0", "L", "\0", "a", "b", "E"]
    codes, ends = truncation.normal_codes(["ab", "c"])
    assert "".join(chr(codes[e]) for e in ends) == "bc" and np.count_nonzero(codes) == 3


def test_ends_of_long_lines_are_those_of_whole_texts(monkeypatch):
    r = random.Random(6)
    texts = ["".join(r.choice(["palabra ", "Ana ", "x" * 30, "1.5 ", "\n", "a: ", ", ", ". ", "https://h.example/" + "y" * 50 + " "]) for _ in range(r.randrange(1, 60))) for _ in range(200)] + ["z" * 5000, "Temas: " + "uno, " * 400, "\n" * 900 + "a"]
    texts = [t for t in texts if t.strip()]
    codes, ends = truncation.normal_codes(texts)
    want = [h[ends] for h in truncation._hashes(codes)]
    monkeypatch.setattr(truncation, "NEAR", 40)
    assert all((a == b).all() for a, b in zip(truncation._ends(texts), want))


def test_marks_wherever_they_begin():
    import re

    at = re.compile(truncation.MARKS, re.ASCII)
    for tail in ("...", "…", "[...]", "[ … ]", "[", "&", "&amp", "&#8230", "\\u00e", "<a href='" + "x" * 500, "</p", "%C3%", "�", "(", "«", "[" + " " * 400 + "..."):
        assert truncation._mark(at, "Una frase y " + tail) is not None, tail
    for tail in ("fin.", "fin", "<b>fin</b>", "100%.", "AT&T.", "[nota]", "x" * 700):
        assert truncation._mark(at, "Una frase y " + tail) is None, tail


def test_small_languages_lean_on_all():
    """A language of few texts takes nearly the threshold of all, one of many its own."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = [("es", i, -1.0 if i % 10 == 0 else 1.0) for i in range(5000)] + [("pt", 10_000 + i, 0.2 if i % 2 else 1.0) for i in range(6)]
    got = {r["language"]: r["threshold"] for r in truncation.thresholds(spark.createDataFrame(rows, "language string, same long, odds double")).collect()}
    assert abs(got["es"] - truncation.DEFAULT) < 1e-9 and abs(got["pt"] - got["es"]) < 0.25


def odds_by_counting(texts):
    """The odds of each of the distinct texts, whose normal form is the text itself, counted in dictionaries."""
    ends, inside, out = Counter(), Counter(), {}
    for t in texts:
        padded = truncation._PAD + t
        for k in truncation.ORDERS:
            ends[padded[-k:]] += 1
            inside.update(padded[i - k + 1 : i + 1] for i in range(16, len(padded) - 1))
    positions = sum(len(t) - 1 for t in texts)
    base = len(texts) / (positions + len(texts))
    for t in texts:
        p = base
        for k in truncation.ORDERS:
            c = (truncation._PAD + t)[-k:]
            e = ends[c] - 1
            p = (e + truncation.PRIOR * p) / (e + inside[c] + truncation.PRIOR)
        out[t] = math.log10(p / base)
    return out


def test_every_final_context_keeps_its_counts(spark):
    r = random.Random(5)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    tails = [letters(16) for _ in range(12000)]
    texts = [letters(3) + t for t in tails for _ in range(2)] + [t + letters(5) for t in tails[::3]]
    texts = sorted(set(texts))
    want = odds_by_counting(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("es"))
    got = {texts[x["doc_id"]]: x["odds"] for x in truncation.end_odds(df).collect()}
    assert got.keys() == want.keys() and [t for t in texts if abs(got[t] - want[t]) > 1e-9] == []


def test_copies_of_a_text_count_once_everywhere(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("abc") for _ in range(r.randrange(20, 40))) for _ in range(60)]
    texts = sorted(set(texts))
    want = odds_by_counting(texts)
    rows = [(i, texts[0] if i % 3 else t) for i, t in enumerate(t for t in texts for _ in range(3))] + [(900 + i, t) for i, t in enumerate(texts)] + [(990, texts[1] + " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("es"))
    got = {x["doc_id"]: x["odds"] for x in truncation.end_odds(df).collect()}
    assert len(got) == len(rows) and all(abs(got[i] - want[t.strip()]) < 1e-9 for i, t in rows)
