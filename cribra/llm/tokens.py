"""Token counts and ids by a public tokenizer's vocabulary, whose path is a parameter."""

from __future__ import annotations

import base64
import os
from bisect import bisect_right
from itertools import accumulate

import numpy as np

DEFAULT_VOCABULARY = os.environ.get("CRIBRA_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Splits text as the public byte-level BPE vocabularies expect it. A fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Counts(dict):
    """Tokens of a word with the blank before it, kept for words seen; bounded."""

    def __init__(self, bpe, most: int):
        self.bpe, self.most = bpe, most

    def __missing__(self, w: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[w] = n = len(self.bpe.encode_ordinary(" " + w))
        return n


class Tokens:
    """count(text) and encode(text). Text between single blanks is looked up, as no token spans a blank's left side."""

    def __init__(self, path: str = DEFAULT_VOCABULARY, most: int = 500_000):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bpe = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known = _Counts(self.bpe, most)
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes of each token
        self.length[list(ranks.values())] = [len(b) for b in ranks]

    def encode(self, text: str) -> list[int]:
        return self.bpe.encode_ordinary(text)

    def _words(self, text: str) -> list[str]:
        """Parts of a text, not empty, that are tokenised one by one: all but the first with a blank before them."""
        if "  " in text or text[0] == " " or text[-1] == " " or "\n " in text or " \n" in text or "\t" in text or "\r" in text or "\xa0" in text:
            return [text]
        return text.split(" ")

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        first, *rest = self._words(text)
        return len(self.encode(first)) + sum(map(self.known.__getitem__, rest))

    def _marks(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and code points of a text up to each end of a token that is one of a code point."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        ends = np.minimum(np.cumsum(self.length[self.encode(text)]), len(raw))
        first = (raw & 0xC0) != 0x80
        good = np.append(first, True)[ends]
        good[-1], ends[-1] = True, len(raw)
        return np.flatnonzero(good) + 1, np.cumsum(first)[ends[good] - 1]

    def spans(self, text: str, most: int) -> list[tuple[int, int, int]]:
        """(start, end, tokens) of consecutive parts of at most `most` tokens each, cut at code points.

        A code point of more tokens than that is a part of its own. Only words in which a part ends are encoded anew.
        """
        if not text:
            return []
        words = self._words(text)
        first, *rest = words
        ends = list(accumulate(map(self.known.__getitem__, rest), initial=len(self.encode(first))))
        if ends[-1] <= most:
            return [(0, len(text), ends[-1])]
        begin = [0, *accumulate((len(w) + 1 for w in rest), initial=len(first))]  # of each word with its blank
        out, i, at, opened = [], 0, 0, -1
        while i < ends[-1]:
            k = bisect_right(ends, i + most)  # the word in which the part has to end
            before = ends[k - 1] if k else 0
            if k == len(words) or before == i + most:
                j, to = before, begin[k]
            else:
                if k != opened:
                    opened, (tokens, signs) = k, self._marks(" " + words[k] if k else first)
                q = int(np.searchsorted(tokens, i + most - before, "right")) - 1
                if q < 0 or before + tokens[q] <= i:
                    q = -1 if before > i else int(np.searchsorted(tokens, i - before, "right"))
                j, to = (before, begin[k]) if q < 0 else (before + int(tokens[q]), begin[k] + int(signs[q]))
            out.append((at, to, j - i))
            i, at = j, to
        return out
