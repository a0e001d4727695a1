"""Cutting long texts at the deepest valleys of lexical cohesion (problem 6)."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cribra.tables import emptied, filled

LIMIT = 3000
OVERLAP = 300
#: Sentences in a block on either side of a possible cut.
BLOCK = 4
#: No piece but the last takes less than this share of what it may.
LEAST = 0.5

_SENTENCE = re.compile(r"(?<=[.!?…])[»”\"')\]]*\s+(?=\S)|\n+")
_WORD = re.compile(r"[^\W\d_]{4,}")


def _ends(text: str) -> list[tuple[int, int]]:
    """(offset after which to cut, rank) of paragraph (2) and sentence ends (1), white space left to the piece before."""
    out = []
    for m in _SENTENCE.finditer(text):
        out.append((m.end(), 2 if "\n" in m[0] else 1))
    return out


def _cohesion(text: str, ends: list[tuple[int, int]], block: int) -> np.ndarray:
    """Cosine similarity of the word counts of the blocks before and after each end, kept as running sums."""
    cuts = [0, *(e for e, _ in ends), len(text)]
    sents = [[w[:7] for w in _WORD.findall(text[a:b].lower())] for a, b in zip(cuts, cuts[1:])]
    left: defaultdict[str, int] = defaultdict(int)
    right: defaultdict[str, int] = defaultdict(int)
    dot = ll = rr = 0
    for s in sents[:block]:
        for w in s:
            rr += 2 * right[w] + 1
            right[w] += 1
    sims = np.empty(len(ends))
    for i in range(len(ends)):
        for w in sents[i]:  # from the block behind to the one before
            rr -= 2 * right[w] - 1
            right[w] -= 1
            dot -= left[w]
            ll += 2 * left[w] + 1
            left[w] += 1
            dot += right[w]
        for w in sents[i + block] if i + block < len(sents) else ():
            rr += 2 * right[w] + 1
            right[w] += 1
            dot += left[w]
        for w in sents[i - block] if i >= block else ():
            ll -= 2 * left[w] - 1
            left[w] -= 1
            dot -= right[w]
        norm = np.sqrt(float(ll) * float(rr))
        sims[i] = dot / norm if norm else 0.0
    return sims


def _depths(sims: np.ndarray) -> np.ndarray:
    """How far each similarity lies below the peaks that are reached uphill to its left and right."""
    out = np.zeros(len(sims))
    for order in (range(len(sims)), range(len(sims) - 1, -1, -1)):
        last = peak = -1.0
        for i in order:
            s = sims[i]
            peak = peak if last >= s else s
            out[i] += peak - s
            last = s
    return out


def _overlap_start(text: str, cut: int, overlap: int, ends: list[int], floor: int) -> int:
    """Where the next piece starts: a sentence start about overlap before the cut, else a word start."""
    want = max(floor, cut - overlap)
    near = ends[bisect_left(ends, max(floor + 1, want - overlap // 3)) : bisect_right(ends, min(cut - 1, want + overlap // 3))]
    if near:
        return min(near, key=lambda e: abs(e - want))
    if want <= floor:
        return max(floor, want)
    space = text.rfind(" ", max(floor, want - overlap // 3), want + 1)
    return space + 1 if space >= 0 and space + 1 < cut else want


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> list[tuple[int, int]]:
    """Spans (start, end) of the pieces: each at most limit code points, consecutive ones share about overlap.

    Text within the limit is one piece, empty text none. In the window between LEAST of a piece and its limit the cut
    goes to the deepest valley, paragraph ends before sentence ends at equal depth; without any end there to a word
    end, without that to the limit. Together the pieces hold every code point. Takes time in proportion to the text.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text))]
    ends = _ends(text)
    offsets = [e for e, _ in ends]
    score = _depths(_cohesion(text, ends, block)) + 0.05 * np.array([r for _, r in ends], np.float64) if ends else np.zeros(0)
    spans, start = [], 0
    while len(text) - start > limit:
        low, high = start + max(int(limit * LEAST), overlap + 1), start + limit
        a, b = bisect_left(offsets, low), bisect_right(offsets, high)
        if b > a:
            at = offsets[a + int(np.argmax(score[a:b]))]
        else:
            space = max(text.rfind(c, low, high) for c in " \t\n\r\xa0")
            at = space + 1 if space >= 0 else high
        spans.append((start, at))
        start = _overlap_start(text, at, overlap, offsets, start)
    spans.append((start, len(text)))
    return spans


def pieces(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """docs(article_id, text) -> (article_id, piece, start, n_chars, text) of every text that isn't null or empty.

    piece counts from 0, start is a code point offset. Each text is cut on its own, so there is no shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for a, t in zip(pdf["article_id"], pdf["text"]):
                for k, (i, j) in enumerate(cut(t or "", limit, overlap)):
                    rows.append((a, k, i, j - i, t[i:j]))
            yield pd.DataFrame(rows, columns=["article_id", "piece", "start", "n_chars", "text"])

    out = docs.select(filled("article_id"), "text").mapInPandas(run, "article_id long, piece int, start int, n_chars int, text string")
    return out.withColumn("article_id", emptied("article_id"))
