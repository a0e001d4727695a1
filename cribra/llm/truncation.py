"""Texts cut off by a field limit or in transfer (problem 10).

A backward character n-gram model: how often a final context - the last 2, 4, 8 or 16 signs - stands at the end of a
text against how often the text goes on behind it. The orders are interpolated from the shortest to the longest, a
text's own end is left out of the counts, and equal texts count once. A complete text ends in a context in which texts
do end; a cut one in a context that is nearly always continued. A mark of omission or damage that a text ends in is one
sign to the model, and where it stands last the text is counted as one that goes on, as the mark says: so the odds of
that sign are those of a context that never ends a text.

Contexts are counted by 64-bit hashes, each with its own counts: ends first, then, in one pass over all texts, the
continuations of those contexts. A bitmap of the final contexts' hashes, of bounded size, goes to the executors and keeps
most other positions out of the shuffle; what it lets pass in error is dropped by the join with the ends.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribra.tables import broadcast_if_small, emptied, filled, materialize

ORDERS = (2, 4, 8, 16)
#: Bits of the bitmap a final context, and its least and largest number of bits in all, as powers of two.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 20, 27
#: Power of two of the bits in a segment of the bitmap.
SEGMENT = 20
#: Contexts that a task holds before it adds them up.
HELD = 1 << 21
#: Pseudo-counts that the shorter context's estimate weighs.
PRIOR = 60.0
#: Characters joined before they are counted at once.
CHUNK = 1 << 18
#: Distinct texts that the histogram of all languages weighs beside a language's own, and a fixed one beside that of all.
WEIGHT = 1000
#: Log10 odds between which thresholds may lie, and where the fixed histogram is emptiest. At 0 a context is an end as
#: often as any position is.
LOW, HIGH, DEFAULT = -0.3, 0.5, 0.1
#: Code points at a text's end that are put into normal form first; see _ends.
NEAR = 600

#: Marks that stand where the rest was lost: omission marks, damaged signs, entities, escapes and tags.
#: Fixed forms.
MARKS = r"(?:\.\.\.|…|\[\s*(?:\.\.\.|…)?\s*\]?|�|&(?:#?\w{0,8})|\\u?[0-9a-fA-F]{0,4}|\\|</?\w*(?:\s[^<>]*)?|%[0-9A-Fa-f]?|[(\[{«“¿¡])\s*$"
#: What a mark at the end becomes; twice, so that the shortest context is the mark alone.
MARK = "\x01\x01"


_PAD = "\0" * ORDERS[-1]
_SPACE, _BREAK, _LETTER, _UPPER, _DIGIT, _OTHER = 1, 2, 3, 4, 5, 6


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point of the basic plane; the others count as _OTHER."""
    t = np.full(1 << 16, _OTHER, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.isspace():
            t[i] = _SPACE
        elif c.isupper() or c.istitle():
            t[i] = _UPPER
        elif c.isalpha() or c == "_" or unicodedata.combining(c):
            t[i] = _LETTER
        elif c.isdigit():
            t[i] = _DIGIT
    t[0], t[10] = 0, _BREAK
    return t


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of True start, and the places behind them."""
    turn = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if len(mask) and mask[0]:
        turn = np.concatenate(([0], turn))
    if len(turn) % 2:
        turn = np.concatenate((turn, [len(mask)]))
    return turn[::2], turn[1::2]


def _within(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places inside the runs."""
    d = np.zeros(n + 1, np.int8)
    d[starts] = 1
    d[ends] -= 1
    return np.cumsum(d[:-1], dtype=np.int8).view(bool)


def _any(mask: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether mask holds anywhere between a start and the next."""
    return np.logical_or.reduceat(mask, starts) if len(starts) else np.zeros(0, bool)


def _shorten(codes: np.ndarray, keep: np.ndarray, starts: np.ndarray, ends: np.ndarray, sign: np.ndarray) -> None:
    """Of the runs with a sign keep the first place alone, as that sign."""
    chosen = sign > 0
    at = starts[chosen]
    keep &= ~_within(len(codes), at, ends[chosen])
    keep[at] = True
    codes[at] = sign[chosen]


def normal_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in normal form, each between pads, and the place of each one's last (of its pad if blank).

    Normal form: capitalised words as A, words with digits as 9, tokens with :// as U, with @ as E, with # before as #,
    one blank or line break between tokens, none at either end, and on a line of the form ``A: ..., ...`` without a
    sentence end, L for what stands behind the label.
    """
    codes = np.frombuffer((_PAD + _PAD.join(texts) + _PAD).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    kind = _classes()[np.minimum(codes, (1 << 16) - 1)]
    point = (codes == 46) | (codes == 44)
    digit = kind == _DIGIT
    kind[1:-1][point[1:-1] & digit[:-2] & digit[2:]] = _DIGIT
    keep = np.ones(len(codes), bool)
    solid = kind >= _LETTER
    starts, ends = _runs(solid)
    colon = np.flatnonzero(codes[:-2] == 58)
    link = np.zeros(len(codes), bool)
    link[colon[(codes[colon + 1] == 47) & (codes[colon + 2] == 47)]] = True
    sign = np.select([_any(link, starts), codes[starts] == 35, _any(codes == 64, starts)], [85, 35, 69], 0).astype(np.uint32)
    word = solid & (kind != _OTHER)
    if sign.any():
        word &= ~_within(len(codes), starts[sign > 0], ends[sign > 0])
        _shorten(codes, keep, starts, ends, sign)
    starts, ends = _runs(word)
    _shorten(codes, keep, starts, ends, np.where(_any(word & (kind == _DIGIT), starts), 57, np.where(kind[starts] == _UPPER, 65, 0)).astype(np.uint32))
    starts, ends = _runs((kind == _SPACE) | (kind == _BREAK))
    _shorten(codes, keep, starts, ends, np.where(_any(kind == _BREAK, starts), 10, 32).astype(np.uint32))
    keep[starts[(kind[starts - 1] == 0) | (kind[ends] == 0)]] = False  # beside a pad
    codes = codes[keep]
    starts, ends = _runs((codes != 10) & (codes != 0))
    s = starts  # a pad follows each line, so three places on is within
    label = (codes[s] == 65) & (codes[s + 1] == 58) & (codes[s + 2] == 32) if len(s) else np.zeros(0, bool)
    if label.any():
        label &= _any(codes == 44, starts) & ~_any((codes == 46) | (codes == 33) | (codes == 63), starts)
        gone = _within(len(codes), starts[label], ends[label])
        for k in range(4):
            gone[starts[label] + k] = False
        codes[starts[label] + 3] = 76
        codes = codes[~gone]
    pad = _runs(codes == 0)[0]
    return codes, pad[1:] - 1 if len(pad) == len(texts) + 1 else _ends_with_blanks(codes, len(texts))


def _ends_with_blanks(codes: np.ndarray, n: int) -> np.ndarray:
    """Ends where some texts are blank: their pads run together, each pad being len(_PAD) places."""
    zero = np.concatenate(([0], np.cumsum(codes == 0)))
    return np.searchsorted(zero, (np.arange(1, n + 1)) * len(_PAD) + 1, "left") - 2


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """Hash of the context that ends at each position, by order."""
    p, k, out = 0x9E3779B97F4A7C15, 1, []
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    while k < ORDERS[-1]:
        prev = np.zeros_like(h)
        prev[k:] = h[:-k]
        prev *= np.uint64(p)
        h = prev + h
        p = p * p & (1 << 64) - 1
        k *= 2
        if k in ORDERS:
            x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((x ^ (x >> np.uint64(32))).view(np.int64))
    return out


def _ends(texts: list[str]) -> list[np.ndarray]:
    """Hash of each text's final context, by order; that of its normal form as a whole.

    Normal form is made line by line, so the lines from NEAR code points before the end on have it for themselves; where
    they leave fewer signs than the longest context has, the whole text is taken.
    """
    near = [t[t.rfind("\n", 0, max(0, len(t) - NEAR)) + 1 :] for t in texts]
    codes, ends = normal_codes(near)
    out = [h[ends] for h in _hashes(codes)]
    k = ORDERS[-1]
    window = np.minimum.accumulate(codes[np.maximum(ends[:, None] - np.arange(k + 1), 0)], axis=1)[:, -1]  # 0 where a pad is near
    short = [i for i in np.flatnonzero(window == 0) if len(near[i]) < len(texts[i])]
    if short:
        codes, ends = normal_codes([texts[i] for i in short])
        for mine, h in zip(out, _hashes(codes)):
            mine[short] = h[ends]
    return out


def final_contexts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, language, same, mark, c2, ... c16): whether a mark stands at the end, and the hash
    of each text's final context, by order."""
    at_end = re.compile(MARKS, re.ASCII)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            texts, marks = [], []
            for t in pdf["text"]:
                m = _mark(at_end, t)
                marks.append(m is not None)
                texts.append(t if m is None else t[:m] + MARK)
            at = {f"c{k}": h for k, h in zip(ORDERS, _ends(texts))}
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "language": pdf["language"], "same": pdf["same"], "mark": marks, **at})

    language = F.lower(F.regexp_extract(F.coalesce("lang", F.lit("")), r"^[A-Za-z]{2}(?=$|[-_])", 0))
    solid = F.expr("trim(TRAILING ' \n\r\t' || char(160) FROM text)")
    rows = docs.where("text IS NOT NULL").select(filled("doc_id"), F.when(language != "", language).otherwise("und").alias("language"), F.xxhash64(solid).alias("same"), solid.alias("text"))
    return rows.where(r"text RLIKE '\\S'").mapInPandas(run, "doc_id long, language string, same long, mark boolean, " + ", ".join(f"c{k} long" for k in ORDERS)).withColumn("doc_id", emptied("doc_id"))


def _mark(at_end: re.Pattern, t: str) -> int | None:
    """Where a mark begins that the text ends in. A tag begins at the last <, brackets at the last [, all others are short."""
    for start in (t.rfind("<"), t.rfind("["), max(0, len(t.rstrip()) - 16)):
        if start >= 0 and (m := at_end.search(t, start)):
            return m.start()
    return None


def _bitmap(ends: DataFrame) -> tuple[int, np.ndarray]:
    """(power of two, packed bits): a bit for each final context's hash, whatever its order."""
    power = min(max((BITS_EACH * ends.count()).bit_length(), LEAST_BITS), MOST_BITS)
    bit = F.col("c").bitwiseAND((1 << power) - 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << SEGMENT, bool)
        bits[pdf["bit"].to_numpy() & (1 << SEGMENT) - 1] = True
        return pd.DataFrame({"segment": pdf["bit"].to_numpy()[:1] >> SEGMENT, "packed": [np.packbits(bits, bitorder="little").tobytes()]})

    rows = ends.select(bit.alias("bit")).distinct().groupBy(F.shiftright("bit", SEGMENT)).applyInPandas(run, "segment long, packed binary").collect()
    out, size = np.zeros(1 << power - 3, np.uint8), 1 << SEGMENT - 3
    for r in rows:
        out[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(r["packed"], np.uint8)
    return power, out


def _continued(texts: DataFrame, seen) -> DataFrame:
    """(k, c, inside): how often a context is followed by something, over all positions of all texts, for all contexts in
    the bitmap; at k = 0 the positions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        power, bits = seen.value
        mask = (1 << power) - 1
        found: dict[int, list[np.ndarray]] = {k: [] for k in ORDERS}
        total, kept, held, size = 0, 0, [], 0

        def count():
            nonlocal total, kept, held, size
            codes, ends = normal_codes(held)
            go = codes != 0
            go[ends] = False
            total += int(go.sum())
            for k, h in zip(ORDERS, _hashes(codes)):
                h = h[go]
                b = h & mask
                found[k].append(h[(bits[b >> 3] >> (b & 7).astype(np.uint8) & 1).view(bool)])
                kept += len(found[k][-1])
            held, size = [], 0

        def sums() -> Iterator[pd.DataFrame]:
            nonlocal kept
            for k, parts in found.items():
                if parts:
                    c, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pd.DataFrame({"k": np.int32(k), "c": c, "inside": n})
                    parts.clear()
            kept = 0

        for pdf in batches:
            for t in pdf["text"]:
                held.append(t)
                size += len(t)
                if size >= CHUNK:
                    count()
                    if kept >= HELD:
                        yield from sums()
        if held:
            count()
        yield from sums()
        yield pd.DataFrame({"k": [0], "c": [0], "inside": [total]})

    return texts.mapInPandas(run, "k int, c long, inside long").groupBy("k", "c").agg(F.sum("inside").alias("inside"))


def end_odds(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang) -> (doc_id, language, same, odds): log10 of P(end | final context) / P(end).

    Null, empty and blank texts have no end and no row.
    """
    spark = docs.sparkSession
    tails = materialize(final_contexts(docs), "tails")
    long = tails.select("same", "mark", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("c")) for k in ORDERS])).alias("x")).select("same", "mark", "x.*")
    ends = materialize(long.distinct().groupBy("k", "c").agg(F.count_if(~F.col("mark")).alias("ends"), F.count_if("mark").alias("on")), "end-contexts")
    # one text of each content, as for the ends
    first = materialize(tails.groupBy("same").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "distinct-texts")
    inside = materialize(_continued(docs.join(broadcast_if_small(first), "doc_id", "left_semi").select("text"), spark.sparkContext.broadcast(_bitmap(ends))), "continued")
    positions = (inside.where("k = 0").first() or {"inside": 0})["inside"] or 1
    texts = first.count() or 1
    model = materialize(ends.join(inside, ["k", "c"], "left").select("k", "c", "ends", (F.coalesce("inside", F.lit(0)) + F.col("on")).alias("inside")), "end-model")
    df = tails
    base = texts / (positions + texts)
    p = F.lit(base)
    for k in ORDERS:
        m = broadcast_if_small(model.where(f"k = {k}")).select(F.col("c").alias(f"c{k}"), F.col("ends").alias(f"e{k}"), F.col("inside").alias(f"i{k}"))
        df = df.join(m, f"c{k}", "left")
        own = F.when(F.col("mark"), 0).otherwise(1)
        e, i = F.greatest(F.coalesce(f"e{k}", F.lit(1)) - own, F.lit(0)), F.coalesce(f"i{k}", F.lit(0))
        p = (e + PRIOR * p) / (e + i + PRIOR)
    return df.select("doc_id", "language", "same", F.log10(p / base).alias("odds"))


def thresholds(odds: DataFrame) -> DataFrame:
    """(language, threshold): in each language the emptiest place between the ends that are continued and the others.

    Over a histogram of fixed bins of distinct texts, smoothed by its neighbours. The fewer texts a language has, the more
    the histogram of all counts beside its own, and beside that a fixed one whose valley is at DEFAULT.
    """
    step = 0.1
    hist = odds.select("language", "same", F.round(F.col("odds") / step).cast("int").alias("b")).distinct().groupBy("language", "b").agg(F.count("*").alias("n")).collect()
    by: dict[str, dict[int, float]] = {}
    bins = range(round(LOW / step) - 2, round(HIGH / step) + 3)
    every = {b: abs(b * step - DEFAULT) for b in bins}
    every = {b: WEIGHT * n / sum(every.values()) for b, n in every.items()}
    for r in hist:
        for d in (by.setdefault(r["language"], {}), every):
            d[r["b"]] = d.get(r["b"], 0) + r["n"]
    whole = sum(every.values())

    def valley(d: dict[int, float]) -> float:
        count = {b: d.get(b, 0) + WEIGHT * every.get(b, 0) / whole for b in bins}
        best = min(bins[2:-2], key=lambda b: (sum(count[b + j] * (3 - abs(j)) for j in range(-2, 3)), abs(b * step - DEFAULT)))
        return best * step

    return odds.sparkSession.createDataFrame([(lang, valley(d)) for lang, d in by.items()], "language string, threshold double")


def truncated(docs: DataFrame) -> DataFrame:
    """(doc_id, odds, threshold, cut) of every text that isn't blank."""
    odds = materialize(end_odds(docs), "end-odds")
    j = odds.join(F.broadcast(thresholds(odds)), "language")
    return j.select("doc_id", "odds", "threshold", (F.col("odds") < F.col("threshold")).alias("cut"))


def truncated_share(docs: DataFrame, flags: DataFrame) -> DataFrame:
    """(source, texts, cut, share): how often each source truncates; null source is a group of its own."""
    j = docs.select("doc_id", "source").join(flags.select("doc_id", "cut"), "doc_id")
    return j.groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut")).withColumn("share", F.col("cut") / F.col("texts"))
