"""Page wrappers per site: which lines of a page are its template, which are the body (problem 7).

A wrapper is a union-free expression over line tokens: items in order that may be missing or repeated, text slots, and no
alternatives. It is inferred in two steps, each of which sums what tasks found, so that a site with a third of all pages
costs no more than any other.

1. Tokens. A line's token is its form (letters only) or, where the same position holds another text on every page, the
   fixed end of the line with the rest as a slot: a prefix up to a mark (``Lea: ...``), a prefix of words before a list or
   a name, a suffix after a comma, a run of tags. Tokens on a share of the site's pages stay. A token mostly followed by
   short unpunctuated lines that are no tokens heads a listing; the run of such lines is its repeated text slot.
2. Alignment. Pages of one site, as streams of tokens and text, are aligned with the expression one by one. A token that
   the expression lacks becomes an optional item at its place; one that stands before an item it once stood behind makes
   the items between into one repeated group. What stands before a page's first text, among it and behind its last text
   are aligned each for itself; the middle is one group that iterates with the text slot. Each task aligns its pages, then
   the tasks' expressions are aligned with each other in the same way.

A page's lines are then matched with its site's expression in order. A line with a token that stands where the expression
has no place for it, or one that nearly no page uses, is body, as are all lines that no item takes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribra.tables import broadcast_if_small, emptied, filled, materialize, table_bytes

MIN_PAGES = 5
MIN_SHARE = 0.03
#: Share of a constant's occurrences that must be followed by a listing line for it to head a listing.
HEAD_SHARE = 0.5
#: Entries of a task's count tables before they are handed on.
FLUSH = 300_000
#: Wrappers above this size on disk (some 20 times that in memory) meet their pages by site instead of being sent.
SEND_BYTES = 4 << 20
#: Pages of a site that meet their wrapper in one task where wrappers aren't sent.
SITE_PAGES = 20_000
#: A token keeps a place (before, among, behind the text) that at least so many pages, and that share of its pages, use.
PLACE_PAGES, PLACE_SHARE = 2, 0.02
BEFORE, AMONG, BEHIND = 0, 1, 2
#: Share of a page's text at either end that may be taken for slots of the template.
EDGE = 0.25
#: Token of a line of a listing.
LISTED = 1
#: Second-level names under which sites are registered in countries' domains. Fixed values.
SECOND_LEVEL = "com co org net gov gob go gub edu mil ac nom info web or ne".split()

MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre setiembre octubre noviembre diciembre".split()
_MONTH = re.compile(r"\b(?:" + "|".join(MONTHS) + r")\b")
_NON_LETTER = re.compile(r"[\W\d_]+")
_MARK = re.compile(r"^([^\W\d_]+(?:\s+[^\W\d_]+){0,2})\s*(:|>|›|–|»|\|)\s*(?=\S)")
_EDGE = " \t\r\xa0-*•·»|…:"


#: ASCII that isn't a letter; other signs stand at line ends only, where _EDGE takes them, or stay as they are.
_DROP = bytes(i for i in range(128) if not chr(i).isalpha())


#: Signs above which a line counts as long.
LONG = 200


def _h(kind: str, s: str) -> int:
    """Even, so that the hash of a long line's form, which is odd, tells itself from all others."""
    return _hash(kind.encode() + s.encode("utf-8", "surrogatepass").translate(None, _DROP))


def _hash(b: bytes) -> int:
    return (xxhash.xxh64_intdigest(b) - (1 << 63)) & ~1


def _letters(s: str) -> bytes:
    """The letters of s, by _DROP and, where signs beyond ASCII are left that aren't letters, by _NON_LETTER."""
    raw = s.encode("utf-8", "surrogatepass").translate(None, _DROP)
    if not raw.isascii() and not (left := raw.decode("utf-8", "surrogatepass")).isalpha():
        raw = _NON_LETTER.sub("", left).encode("utf-8", "surrogatepass")
    return raw


def line_info(line: str, long_forms: bool = True) -> tuple[int, int, bool, int] | None:
    """(form, slot, title-like, words) of a line, None for a blank one. form and slot are hashes, 0 if there is none.

    Without long_forms the form of a long line is 0 as well, for sites none of whose tokens is one.
    """
    x = line.strip(_EDGE)
    if not x:
        return None
    if len(x) > LONG:
        return (_h("form", x.lower().replace("\xa0", "")) | 1 if long_forms else 0, _slot_of_list(x), False, x.count(" ") + 1)
    low = x.lower()
    words = x.split()
    n = len(words)
    slot = 0
    letters = _letters(_MONTH.sub("", low) if len(x) < 60 else low)
    if not letters:
        return (0, 0, False, n)
    if x[0] == "#" and all(w[0] == "#" for w in words):
        slot = _h("tags", "")
    elif m := _MARK.match(x):
        slot = _h("mark" + m[2], m[1].lower())
    elif 2 <= n <= 7 and words[0][0].isalpha():
        tail = x.rstrip(".").rsplit(",", 1)
        if len(tail) == 2 and len(tail[1].split()) == 1 and all(w[0].isupper() for w in tail[0].split()):
            slot = _h("end", tail[1].lower())
        elif n >= 3 and all(w[0].isupper() for w in words[1:]) and len(words[0]) <= 4:
            slot = _h("name", words[0].lower())
        elif n >= 4 and not words[1][0].isupper() and all(w[0].isupper() for w in words[2:]):
            slot = _h("name", words[0].lower() + " " + words[1].lower())
        elif n >= 4 and x.isupper() and len(words[1]) <= 3:
            slot = _h("name", words[0].lower() + " " + words[1].lower())
    if not slot and n >= 4:
        slot = _slot_of_list(x)
    title = 4 <= n <= 22 and len(x) <= 150 and x[-1] not in ".;," and x[0] not in "—–«“\""
    return (_hash(b"form" + letters), slot, title, n)


def _slot_of_list(x: str) -> int:
    """Two words and then a list: a comma at least every six words, none after the second word."""
    commas = x.count(",")
    if commas < 2 or x[-1] in "?!" or commas * 6 < x.count(" ") + 1:
        return 0
    two = x.split(None, 2)[:2]
    return 0 if len(two) < 2 or two[1][-1:] == "," else _h("list", f"{two[0]} {two[1]}".lower())


class Lines:
    """line_info with a bounded memory of short lines, most of which come again."""

    def __init__(self, most: int = 200_000):
        self.most, self.known = most, {}

    def __call__(self, line: str, long_forms: bool = True):
        if len(line) > 140:
            return line_info(line, long_forms)
        if line in self.known:
            return self.known[line]
        if len(self.known) >= self.most:
            self.known.clear()
        self.known[line] = r = line_info(line)
        return r


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task: pages (kind 0), nodes (kind 1: site, token) and edges (kind 2: site, token, next line) with counts."""
    info, nodes, edges, size = Lines(), defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int)), 0
    known = info.known

    def out():
        for site, d in nodes.items():
            h = np.fromiter(d.keys(), np.int64, len(d))
            yield pd.DataFrame({"site": site, "kind": np.where(h == 0, 0, 1).astype(np.int32), "h": h, "h2": 0, "slot2": 0, "n": np.fromiter(d.values(), np.int64, len(d))})
        for site, d in edges.items():
            k = np.array(list(d.keys()), np.int64)
            yield pd.DataFrame({"site": site, "kind": np.int32(2), "h": k[:, 0], "h2": k[:, 1], "slot2": k[:, 2], "n": np.fromiter(d.values(), np.int64, len(d))})
        nodes.clear()
        edges.clear()

    for pdf in batches:
        for site, text in zip(pdf["site"], pdf["text"]):
            seen, last = {0}, 0
            edge = edges[site]
            for line in (text or "").split("\n"):
                i = known[line] if line in known else info(line)
                if i is None:
                    continue
                form, slot, title, _ = i
                if title and last:
                    edge[(last, form, slot)] += 1
                seen.add(form)
                if slot:
                    seen.add(slot)
                last = form
            node = nodes[site]
            for h in seen:
                node[h] += 1
            size += len(seen)
            if not edge:
                del edges[site]
        if size > FLUSH:
            yield from out()
            size = 0
    yield from out()


def site_column() -> F.Column:
    """Registered name in the url, else the source: pages of one site share it, whatever host section they are on.

    The label before the public suffix: the last one, or the last two where the second is one of SECOND_LEVEL under a
    country's domain.
    """
    host = F.regexp_extract(F.lower(F.trim("url")), r"^(?:[a-z]+:)?//(?:[^/?#@\s]*@)?([^/:?#\s]+)", 1)
    name = F.regexp_extract(host, rf"([^.]+)\.(?:(?:{'|'.join(SECOND_LEVEL)})\.[a-z][a-z]|[^.]+)\.?$", 1)
    return F.coalesce(F.when(name != "", name), F.when(F.trim("source") != "", F.lower(F.trim("source"))), F.lit(""))


def pages_of(news: DataFrame) -> DataFrame:
    return news.select("article_id", site_column().alias("site"), "text")


def learn_tokens(pages: DataFrame) -> DataFrame:
    """pages(site, text) -> (site, h, head): the tokens of each site, head where one heads a listing.

    Tokens of one site that stand on pages of another too (syndicated pages, platforms that sites share) are the other's
    as well. Null text is an empty page; an empty input gives no tokens.
    """
    schema = "site string, kind int, h long, h2 long, slot2 long, n long"
    raw = pages.select("site", "text").mapInPandas(_count, schema)
    sums = materialize(raw.groupBy("site", "kind", "h", "h2", "slot2").agg(F.sum("n").alias("n")), "wrapper-counts")
    total = sums.where("kind = 0").select("site", F.col("n").alias("pages"))
    const = (
        sums.where("kind = 1").join(broadcast_if_small(total), "site")
        .where(F.col("n") >= F.greatest(F.lit(float(MIN_PAGES)), MIN_SHARE * F.col("pages")))
        .select("site", "h", F.col("n").alias("times"))
    )
    const = materialize(const, "wrapper-constants")
    key = broadcast_if_small(const.select("site", F.col("h").alias("x")))
    follow = (
        sums.where("kind = 2").join(broadcast_if_small(const), ["site", "h"], "left_semi")
        .join(key.withColumnRenamed("x", "h2"), ["site", "h2"], "left_anti")
        .join(key.withColumnRenamed("x", "slot2"), ["site", "slot2"], "left_anti")
        .groupBy("site", "h").agg(F.sum("n").alias("titles"))
    )
    own = const.join(follow, ["site", "h"], "left").select("site", "h", F.coalesce(F.col("titles") >= HEAD_SHARE * F.col("times"), F.lit(False)).alias("head"))
    own = materialize(own, "wrappers")
    known = broadcast_if_small(materialize(own.groupBy("h").agg((F.avg(F.col("head").cast("int")) > 0.5).alias("mostly")), "wrapper-tokens"))
    here = sums.where("kind = 1").join(known, "h").select("site", "h", "mostly")
    several = here.groupBy("h").agg(F.count("*").alias("sites")).where("sites >= 2").select("h")
    here = materialize(here.join(several, "h", "left_semi"), "wrapper-shared")
    both = own.join(here, ["site", "h"], "full")
    return materialize(both.select("site", "h", (F.coalesce("head", F.lit(False)) | F.coalesce("mostly", F.lit(False))).alias("head")), "wrappers")


def label_lines(lines: list[str], info: Lines, tokens, heads, long_forms: bool = True) -> list[int | None]:
    """For each line its token, LISTED for one of a listing, 0 for text, None for a blank line."""
    marks: list[int | None] = []
    listing = first = False
    known = info.known
    for line in lines:
        i = known[line] if line in known else info(line, long_forms)
        if i is None:
            marks.append(None)
            continue
        form, slot, title, n = i
        if form in tokens:
            marks.append(form or LISTED)
            listing = first = form in heads
        elif slot and slot in tokens:
            marks.append(slot)
            listing = first = False
        elif listing and (title or first and n <= 22 and 4 <= n and len(line) <= 160):
            marks.append(LISTED)
            first = False
        else:
            marks.append(0)
            listing = first = False
    return marks


def zones(lines: list[str], marks: list[int | None]) -> tuple[list[int], list[int]]:
    """Where each line with a token stands: BEFORE, AMONG or BEHIND the page's text; and the same with at most EDGE of the
    text's signs at either end taken for slots of the template. Without text all are BEFORE."""
    size = [len(x) if m == 0 else 0 for x, m in zip(lines, marks)]
    whole, seen = sum(size), 0
    edge, out, near = EDGE * whole, [], []
    for n, m in zip(size, marks):
        if m:
            out.append(BEFORE if not seen else BEHIND if seen == whole else AMONG)
            near.append(BEFORE if seen <= edge else BEHIND if whole - seen <= edge else AMONG)
        seen += n
    return out, near


class Expression:
    """Groups of tokens in order. Each group may be missing; one of several tokens iterates over them."""

    def __init__(self) -> None:
        self.groups: list[dict[int, int]] = []  # token: pages
        self.where: dict[int, int] = {}

    def _index(self, start: int) -> None:
        for i in range(start, len(self.groups)):
            for t in self.groups[i]:
                self.where[t] = i

    def _join(self, lo: int, hi: int) -> None:
        """The groups lo to hi become one that iterates."""
        if lo < hi:
            for g in self.groups[lo + 1 : hi + 1]:
                for t, n in g.items():
                    self.groups[lo][t] = self.groups[lo].get(t, 0) + n
            del self.groups[lo + 1 : hi + 1]
            self._index(lo)

    def align(self, group: dict[int, int], at: int) -> int:
        """Aligns one group that comes behind place at; gives its place."""
        known = [self.where[t] for t in group if t in self.where]
        if not known:
            at += 1
            self.groups.insert(at, dict(group))
            self._index(at)
            return at
        lo, hi = min(known), max(known)
        if lo < at:
            hi = max(hi, at)  # it stood behind what it now stands before
        self._join(lo, hi)
        mine = self.groups[lo]
        for t, n in group.items():
            mine[t] = mine.get(t, 0) + n
            self.where[t] = lo
        return lo

    def absorb(self, tokens: list[int]) -> None:
        """One page's tokens in order."""
        at, seen = -1, set()
        for t in tokens:
            g = self.where.get(t, -1)
            if g >= 0 and g >= at:
                at = g
                if t not in seen:
                    self.groups[g][t] += 1
            else:
                at = self.align({t: 0 if t in seen else 1}, at)
            seen.add(t)

    def merge(self, groups: list[dict[int, int]]) -> None:
        at = -1
        for g in groups:
            at = self.align(g, at)


def match(stream: list[tuple[int, int, int]], places: dict[int, dict[int, int]]) -> list[bool]:
    """For a page's (zone, zone without the text's ends, token) in order: whether the expression has a place for it.

    places: group of each token by zone. A listing goes with the line that heads it.
    """
    out, at = [], {BEFORE: -1, AMONG: -1, BEHIND: -1}
    for z, near, t in stream:
        ok = t == LISTED and (not out or out[-1])
        for zone in (z, near) if t != LISTED else ():
            g = places.get(zone, {}).get(t, -1)
            if g >= 0 and (zone == AMONG or g >= at[zone]):
                ok, at[zone] = True, g
                break
        out.append(ok)
    return out


PARTS = "kind int, article_id long, site string, furniture array<int>, body string, stream binary, zone int, piece long, place int, h long, n long"


def _align(batches: Iterator[pd.DataFrame], sets: dict[str, tuple[frozenset, frozenset, bool]], number: int) -> Iterator[pd.DataFrame]:
    """Rows of kind 0: pages without the lines that have a token; of kind 1: the expressions of these pages by site. number tells
    the parts of one site's pages from each other."""
    info, none, held = Lines(), (frozenset(), frozenset(), False), 0
    made: dict[tuple[str, int], Expression] = {}
    piece = number << 32

    def expressions() -> pd.DataFrame:
        rows = [(1, None, site, None, None, None, zone, piece, place, t, n) for (site, zone), e in made.items() for place, g in enumerate(e.groups) for t, n in g.items()]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")])

    for pdf in batches:
        rows = []
        for a, site, text in zip(pdf["article_id"], pdf["site"], pdf["text"]):
            tokens, heads, long_forms = sets.get(site, none)
            lines = (text or "").split("\n")
            marks = label_lines(lines, info, tokens, heads, long_forms)
            at = [k for k, m in enumerate(marks) if m]
            z, near = zones(lines, marks)
            t = [m for m in marks if m]
            for zone in (BEFORE, AMONG, BEHIND):
                mine = [x for x, y in zip(t, z) if y == zone and x != LISTED]
                if mine:
                    e = made.get((site, zone))
                    if e is None:
                        e = made[site, zone] = Expression()
                    before = len(e.where)
                    if zone == AMONG:
                        e.merge([dict.fromkeys(mine, 1)])  # one group that iterates with the text
                    else:
                        e.absorb(mine)
                    held += len(e.where) - before
            rows.append((0, a, site, at, "\n".join(x for x, m in zip(lines, marks) if not m) if at else text or "", np.array([z, near, t], np.int64).tobytes(), None, None, None, None, None))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")])
        if held > FLUSH:
            yield expressions()
            made.clear()
            piece, held = piece + 1, 0
    if made:
        yield expressions()


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The expression of one site and zone from those of several tasks, numbered by way."""
    e = Expression()
    for _, part in pdf.sort_values(["piece", "place", "h"]).groupby("piece", sort=True):
        groups: dict[int, dict[int, int]] = {}
        for place, h, n in zip(part["place"].tolist(), part["h"].tolist(), part["n"].tolist()):
            groups.setdefault(place, {})[h] = n
        e.merge(list(groups.values()))
    rows = [(pdf["site"].iloc[0], int(pdf["zone"].iloc[0]), int(pdf["way"].iloc[0]), place, t, n) for place, g in enumerate(e.groups) for t, n in g.items()]
    return pd.DataFrame(rows, columns=["site", "zone", "piece", "place", "h", "n"])


def _sets(rows) -> dict[str, tuple[frozenset, frozenset, bool]]:
    """By site its tokens, those that head listings, and whether a long line's form is among them."""
    out: dict[str, tuple[set, set]] = {}
    for r in rows:
        c, hd = out.setdefault(r["site"], (set(), set()))
        c.add(r["h"])
        if r["head"]:
            hd.add(r["h"])
    return {k: (frozenset(c), frozenset(d), any(t & 1 for t in c)) for k, (c, d) in out.items()}


def align_pages(pages: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages(article_id, site, text), tokens of learn_tokens -> (article_id, site, furniture, body, stream), (site, zone, place, h, n).

    The first holds each page as its tokens alone part it, the second the expressions: group of each token by zone, and
    the pages that use it there, without places that too few use on the site and everywhere.
    """
    spark = pages.sparkSession
    if table_bytes(tokens) <= SEND_BYTES:
        sent = spark.sparkContext.broadcast(_sets(tokens.toLocalIterator()))
        out = pages.select(filled("article_id"), "site", "text").mapInPandas(lambda b: _align(b, sent.value, TaskContext.get().partitionId()), PARTS)
    else:
        # a site's pages meet its tokens by (site, salt); a large site has as many salts as it needs
        size = pages.groupBy("site").agg(F.ceil(F.count("*") / SITE_PAGES).cast("int").alias("salts"))
        size = broadcast_if_small(materialize(size, "site-sizes"))
        left = pages.select(filled("article_id"), "site", "text").join(size, "site").withColumn("salt", F.pmod(F.xxhash64("article_id"), F.col("salts")).cast("int"))
        right = tokens.join(size.select(F.col("site").alias("site_"), F.col("salts").alias("ways")), F.col("site") == F.col("site_")).select("site", "h", "head", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("salt"))

        def one(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
            own = _sets(t.to_dict("records"))
            return pd.concat(list(_align(iter([p]), own, int(p["salt"].iloc[0]))), ignore_index=True) if len(p) else pd.DataFrame(columns=[c.split()[0] for c in PARTS.split(", ")])

        out = left.groupBy("site", "salt").cogroup(right.groupBy("site", "salt")).applyInPandas(one, PARTS)
    out = materialize(out, "pages-aligned")
    parts = out.where("kind = 1").select("site", "zone", F.coalesce("piece", F.lit(0)).alias("piece"), "place", "h", "n")
    # a thousand tasks' expressions of a site first, then those of all thousands
    merged = "site string, zone int, piece long, place int, h long, n long"
    parts = parts.withColumn("way", F.shiftright("piece", 42)).groupBy("site", "zone", "way").applyInPandas(_merge, merged)
    whole = parts.withColumn("way", F.lit(0)).groupBy("site", "zone").applyInPandas(_merge, merged)
    whole = materialize(whole.select("site", "zone", "place", "h", "n"), "expressions")
    here = whole.groupBy("site", "h").agg(F.sum("n").alias("of"))
    all_ = whole.groupBy("h", "zone").agg(F.sum("n").alias("zn"))
    every = all_.join(all_.groupBy("h").agg(F.sum("zn").alias("zof")), "h")
    kept = whole.join(here, ["site", "h"]).join(every, ["h", "zone"]).where(
        (F.col("n") >= F.greatest(F.lit(PLACE_PAGES), PLACE_SHARE * F.col("of"))) | (F.col("zn") >= F.greatest(F.lit(MIN_PAGES), PLACE_SHARE * F.col("zof")))
    )
    return out.where("kind = 0").select(emptied("article_id"), "site", "furniture", "body", "stream"), materialize(kept.select("site", "zone", "place", "h", "n"), "expressions")


def split_body(news: DataFrame, tokens: DataFrame) -> DataFrame:
    """news(article_id, site, text, ...) -> (article_id, furniture array<int>, body string).

    furniture: numbers of the non-blank lines that the wrapper takes. body: the other lines, joined by line breaks. Rows of one
    id are taken for one page. A page without an id is parted by its tokens alone.
    """
    aligned, expr = align_pages(news, tokens)
    per = expr.groupBy("site").agg(F.collect_list(F.struct("zone", "place", "h")).alias("e"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict[int, dict[int, int]]] = sent.value if sent is not None else {}
        for pdf in batches:
            rows = []
            for a, site, lines, raw, *e in zip(pdf["article_id"], pdf["site"], pdf["furniture"], pdf["stream"], *([] if sent is not None else [pdf["e"]])):
                if not len(lines):
                    continue
                stream = np.frombuffer(raw, np.int64).reshape(3, -1).T.tolist()
                places = known.get(site, {}) if not e else _places(e[0])
                ok = match(stream, places)
                if not all(ok):
                    rows.append((a, [int(x) for x, y in zip(lines, ok) if y]))
            yield pd.DataFrame(rows, columns=["article_id", "__kept"])

    small = table_bytes(expr) <= SEND_BYTES
    sent = news.sparkSession.sparkContext.broadcast({r["site"]: _places(r["e"]) for r in per.toLocalIterator()}) if small else None
    streams = aligned.where("article_id IS NOT NULL").select("article_id", "site", "furniture", "stream")
    streams = streams if small else streams.join(per, "site", "left")
    back = streams.mapInPandas(run, "article_id long, __kept array<int>").groupBy("article_id").agg(F.first("__kept").alias("__kept"))
    back = broadcast_if_small(materialize(back, "out-of-place"))
    body = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: ~F.array_contains("__kept", i)), "\n")
    mended = news.select("article_id", "text").join(back, "article_id").select("article_id", F.col("__kept").alias("furniture"), body.alias("body"))
    return aligned.join(back, "article_id", "left_anti").select("article_id", "furniture", "body").union(mended)


def _places(e) -> dict[int, dict[int, int]]:
    out: dict[int, dict[int, int]] = {}
    for r in e if e is not None else ():
        out.setdefault(r["zone"], {})[r["h"]] = r["place"]
    return out
