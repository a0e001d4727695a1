"""Filling containers of fixed capacity with related documents (problem 8).

Items are sharded by a term they hold: the most frequent one that no more than a shard's items hold, so that items with
such a term in common meet. In each shard a BM25 inverted index over its items gives, for a seed, unused neighbours by
lexical closeness, which greedily fill the seed's container. Seeds go from the largest item down; what no neighbour fills
is filled by the unused item that fits best. A shard holds a bounded number of items and is one task, so packing costs
the same per item at every size and nothing is gathered beyond it.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribra.llm.tokens import DEFAULT_VOCABULARY, Tokens
from cribra.tables import broadcast_if_small, emptied, filled, materialize

CAPACITY = 512
#: Items in a shard.
SHARD_ITEMS = 4000
#: Power of two of the counters that say how many items hold a term; terms that share one only change the sharding.
COUNTERS = 20
#: Terms that more than this share of a shard's items hold are scored as rows of a matrix, the others by their postings.
DENSE = 0.25
#: Best neighbours that are put in order at once.
NEXT = 64
#: A gap of one part of the capacity in so many counts as none while neighbours are chosen.
TOLERANCE = 256
K1, B = 1.2, 0.75

_TERM = re.compile(r"[^\W\d_]+")


class _Terms(dict):
    """Hashes of the terms in a text without blanks, kept for texts seen; bounded. A blank is no part of a term and of no
    letter's lower case."""

    def __missing__(self, text: str) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        self[text] = r = tuple(zlib.crc32(w.encode()) & 0x7FFFFFFF for w in _TERM.findall(text.lower()))
        return r


def items(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, part, start, n_chars, tokens, terms, times): parts of at most capacity tokens, doc_id filled.

    Only documents above the capacity have several parts. terms: hashes of the part's words, times: how often each stands
    there, both as 32-bit ints. Null and empty texts have no tokens and no item.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, ids = Tokens(vocabulary), _Terms()
        for pdf in batches:
            out = []
            for d, text in zip(pdf["doc_id"], pdf["text"]):
                for part, (i, j, k) in enumerate(tok.spans(text, capacity) if text else ()):
                    terms: dict[int, int] = {}
                    if k < capacity:  # a full part needs no neighbours
                        for w, n in Counter(text[i:j].split(" ")).items():
                            for h in ids[w]:
                                terms[h] = terms.get(h, 0) + n
                    out.append((d, part, i, j - i, k, np.fromiter(terms.keys(), np.int32, len(terms)).tobytes(), np.fromiter(terms.values(), np.int32, len(terms)).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "part", "start", "n_chars", "tokens", "terms", "times"])

    return docs.select(filled("doc_id"), "text").mapInPandas(run, "doc_id long, part int, start int, n_chars int, tokens int, terms binary, times binary")


def _holders(rest: DataFrame) -> np.ndarray:
    """How many items hold a term, by the term's counter: as many numbers at every size."""
    mask = (1 << COUNTERS) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(mask + 1, np.int64)
        for pdf in batches:
            total += np.bincount(np.frombuffer(b"".join(pdf["terms"]), np.int32) & mask, minlength=mask + 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"c": at.astype(np.int32), "n": total[at]})

    out = np.zeros(mask + 1, np.int64)
    for r in rest.select("terms").mapInPandas(run, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["c"]] = r["n"]
    return out


def _sharded(rest: DataFrame) -> DataFrame:
    """Adds shard: by the most frequent term that at most SHARD_ITEMS / 4 items hold, else by the item itself; a shard that comes
    out larger than planned is split by item."""
    mask, spark = (1 << COUNTERS) - 1, rest.sparkSession
    holders = spark.sparkContext.broadcast(_holders(rest).astype(np.int32))

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = holders.value
        for pdf in batches:
            keys = []
            for raw in pdf["terms"]:
                t = np.frombuffer(raw, np.int32)
                c = n[t & mask]
                ok = np.flatnonzero((c > 1) & (c <= SHARD_ITEMS // 4))
                keys.append(int(t[ok[np.lexsort((t[ok], -c[ok]))[0]]]) if len(ok) else None)
            yield pdf.assign(key=pd.array(keys, dtype="Int64"))

    keyed = materialize(rest.mapInPandas(key, ", ".join(f"{c} {t}" for c, t in rest.dtypes) + ", key long"), "keyed-items")
    shards = max(1, -(-keyed.count() // SHARD_ITEMS))
    keyed = keyed.withColumn("shard", F.pmod(F.coalesce(F.xxhash64("key"), F.xxhash64("doc_id", "part")), F.lit(shards)).cast("int"))
    size = materialize(keyed.groupBy("shard").agg(F.ceil(F.count("*") / (1.5 * SHARD_ITEMS)).cast("int").alias("ways")), "shard-sizes")
    split = F.pmod(F.xxhash64("part", "doc_id"), F.col("ways")).cast("int")
    return keyed.join(broadcast_if_small(size), "shard").withColumn("piece", split).drop("key", "ways")


class _Index:
    """BM25 over a shard's items."""

    def __init__(self, terms: list[np.ndarray], times: list[np.ndarray]):
        n = len(terms)
        count = np.array([len(t) for t in terms])
        length = np.array([t.sum() for t in times], float)
        all_t, tf, who = np.concatenate(terms), np.concatenate(times).astype(float), np.repeat(np.arange(n), count)
        self.vocabulary, t = np.unique(all_t, return_inverse=True)
        df = np.bincount(t, minlength=len(self.vocabulary))
        weight = np.log(1 + (n - df + 0.5) / (df + 0.5))[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[who] / max(length.mean(), 1e-9)))
        dense = df > DENSE * n
        row = np.cumsum(dense) - 1
        self.matrix = np.zeros((int(dense.sum()), n), np.float32)
        inside = dense[t]
        self.matrix[row[t[inside]], who[inside]] = weight[inside]
        order = np.argsort(t[~inside], kind="stable")
        self.items, self.weights = who[~inside][order], weight[~inside][order]
        self.terms = t[~inside][order]
        starts = np.concatenate(([0], np.cumsum(count)))
        self.dense = [row[t[a:b]][dense[t[a:b]]] for a, b in zip(starts, starts[1:])]
        self.sparse = [t[a:b][~dense[t[a:b]]] for a, b in zip(starts, starts[1:])]
        self.n = n
        self._point()

    def _point(self) -> None:
        self.first = np.searchsorted(self.terms, np.arange(len(self.vocabulary) + 1)).tolist()
        self.held = len(self.items)

    def keep(self, unused: np.ndarray) -> None:
        """Leaves out the postings of used items once they are most of them."""
        live = unused[self.items]
        if live.sum() < 0.6 * self.held:
            self.items, self.weights, self.terms = self.items[live], self.weights[live], self.terms[live]
            self._point()

    def score(self, seed: int) -> np.ndarray:
        """Every item's score against all terms of the seed."""
        out = self.matrix[self.dense[seed]].sum(axis=0, dtype=np.float64)
        spans = [(self.first[t], self.first[t + 1]) for t in self.sparse[seed].tolist()]
        spans = [(a, b) for a, b in spans if b > a]
        if spans:
            at = np.concatenate([self.items[a:b] for a, b in spans])
            out += np.bincount(at, weights=np.concatenate([self.weights[a:b] for a, b in spans]), minlength=self.n)
        return out


def _pack(pdf: pd.DataFrame, capacity: int, measure: bool) -> pd.DataFrame:
    """box of each item of one shard; shared: share of an item's terms that the seed of its box holds, other: that the seed of
    another box holds, for comparison; both only if they are to be measured, and not for seeds."""
    pdf = pdf.sort_values(["tokens", "doc_id", "part"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    size, n = pdf["tokens"].to_numpy(), len(pdf)
    terms = [np.frombuffer(t, np.int32) for t in pdf["terms"]]
    index = _Index(terms, [np.frombuffer(t, np.int32) for t in pdf["times"]])
    used = np.zeros(n, bool)
    left: list[tuple[int, int]] = sorted((int(s), -i) for i, s in enumerate(size))  # unused, by size
    box = np.full(n, -1)
    seeds: list[int] = []
    taken = 0

    def take(i: int) -> None:
        used[i] = True
        box[i] = len(seeds) - 1
        left.pop(bisect_right(left, (int(size[i]), -i)) - 1)

    for seed in range(n):
        if used[seed]:
            continue
        room = capacity - int(size[seed])
        seeds.append(seed)
        take(seed)
        taken += 1
        if room > 0 and left and left[0][0] <= room:
            if taken % 64 == 0:
                index.keep(~used)
            score = index.score(seed)
            fit = np.flatnonzero(~used & (size <= room) & (score > 0))
            for i in _by_score(fit, score[fit]):
                # a neighbour goes in if it leaves no gap, or one that some unused item can fill
                rest = room - int(size[i])
                if rest >= 0 and not used[i] and (rest <= capacity // TOLERANCE or _fits_well(left, rest, capacity)):
                    take(i)
                    room = rest
                    if room <= capacity // TOLERANCE or not left or left[0][0] > room:
                        break
            while room > 0 and left and left[0][0] <= room:
                s, i = left[bisect_right(left, (room, 1)) - 1]
                take(-i)
                room -= s
    shared, other = np.full(n, np.nan), np.full(n, np.nan)
    held = [set(terms[s].tolist()) for s in seeds]
    for i in range(n) if measure else ():
        if i != seeds[box[i]] and len(terms[i]):
            mine = terms[i].tolist()
            shared[i] = sum(t in held[box[i]] for t in mine) / len(mine)
            other[i] = sum(t in held[(box[i] + len(seeds) // 2) % len(seeds)] for t in mine) / len(mine)
    return pd.DataFrame({"doc_id": pdf["doc_id"], "part": pdf["part"], "start": pdf["start"], "n_chars": pdf["n_chars"], "tokens": size, "shard": pdf["shard"], "piece": pdf["piece"], "box": box, "shared": shared, "other": other})


def _by_score(at: np.ndarray, score: np.ndarray) -> Iterator[int]:
    """Items by score downwards, ties by number; the best NEXT are put in order first."""
    if len(at) > 2 * NEXT:
        least = np.partition(score, len(score) - NEXT)[len(score) - NEXT]
        best = score >= least
        yield from at[best][np.lexsort((at[best], -score[best]))].tolist()
        at, score = at[~best], score[~best]
    yield from at[np.lexsort((at, -score))].tolist()


def _fits_well(left: list[tuple[int, int]], room: int, capacity: int) -> bool:
    """Some unused item fills the room but for the tolerated gap."""
    k = bisect_right(left, (room, 1)) - 1
    return k >= 0 and room - left[k][0] <= capacity // TOLERANCE


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, part, start, n_chars, tokens, container).

    Every item is in one container, a string, and no container holds more than capacity tokens, but for a single code
    point that alone exceeds it.
    """
    return packed(docs, capacity, vocabulary, False).select("doc_id", "part", "start", "n_chars", "tokens", "container")


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = DEFAULT_VOCABULARY, measure: bool = True) -> DataFrame:
    """pack with shared and other, see _pack."""
    it = materialize(items(docs, capacity, vocabulary), "items")
    none = F.lit(None).cast("double")
    full = it.where(F.col("tokens") >= capacity).select("doc_id", "part", "start", "n_chars", "tokens", F.concat_ws("-", F.lit("f"), "doc_id", "part").alias("container"), none.alias("shared"), none.alias("other"))
    rest = _sharded(it.where(F.col("tokens") < capacity))
    out = rest.groupBy("shard", "piece").applyInPandas(lambda p: _pack(p, capacity, measure), "doc_id long, part int, start int, n_chars int, tokens int, shard int, piece int, box int, shared double, other double")
    nan = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    both = full.union(out.select("doc_id", "part", "start", "n_chars", "tokens", F.concat_ws("-", F.lit("s"), "shard", "piece", "box").alias("container"), nan("shared"), nan("other")))
    return both.withColumn("doc_id", emptied("doc_id"))


def report(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """packed rows -> one row: items, containers, fill (share of the capacity taken), and the mean share of an item's terms that
    the seed of its container and that of another one hold."""
    return rows.agg(
        F.count("*").alias("items"), F.countDistinct("container").alias("containers"), F.round(F.sum("tokens") / (F.lit(capacity) * F.countDistinct("container")), 6).alias("fill"),
        F.round(F.avg("shared"), 6).alias("shared"), F.round(F.avg("other"), 6).alias("other"),
    )
