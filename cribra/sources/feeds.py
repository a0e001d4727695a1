"""Feeds, sitemaps and robots rules, from stored documents or a fetcher given by the caller.

A fetcher is a function url -> text or None; live fetching is no part of this library. Errors of one address are
swallowed: it gives no rows.
"""

from __future__ import annotations

import random
import threading
import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Fetch = Callable[[str], str | None]


def _items(text: str | None, kind: str) -> list[str]:
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError:
        return []
    out = []
    for e in root.iter():
        tag = e.tag.rpartition("}")[2]
        if kind == "sitemap" and tag == "loc" or kind == "rss" and tag == "link":
            link = (e.text or "").strip() or e.attrib.get("href", "").strip()
            if link:
                out.append(link)
    return out


def feed_links(text: str | None) -> list[str]:
    """Links of the entries, the channel's own left out."""
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError:
        return []
    out = []
    for e in root.iter():
        if e.tag.rpartition("}")[2] in ("item", "entry"):
            for c in e:
                if c.tag.rpartition("}")[2] == "link":
                    link = (c.text or "").strip() or c.attrib.get("href", "").strip()
                    if link:
                        out.append(link)
                        break
    return out


def sitemap_links(text: str | None) -> list[str]:
    return _items(text, "sitemap")


def sitemap_urls(address: str, fetch: Fetch, seconds: float = 30.0, most: int = 50_000) -> list[str]:
    """All page addresses of a sitemap and of the sitemaps that an index names, each read once; nothing after `seconds`.

    most bounds how many sitemaps of an index are followed, against an index that names itself under ever new addresses.
    """
    end, todo, seen, out = time.monotonic() + seconds, [address], {address}, []
    while todo:
        try:
            text = within(lambda a=todo.pop(): fetch(a), end - time.monotonic())
        except TimeoutError:
            return []
        links = sitemap_links(text)
        if is_index(text):
            new = [x for x in links if x not in seen][: most - len(seen)]
            seen.update(new)
            todo += new[::-1]
        else:
            out += links
    return out


def is_index(text: str | None) -> bool:
    try:
        return ET.fromstring(text or "").tag.rpartition("}")[2] == "sitemapindex"
    except ET.ParseError:
        return False


def within(call: Callable, seconds: float):
    """What the call gives, or TimeoutError if it takes longer; its thread is left to itself. Errors pass through."""
    if seconds <= 0:
        raise TimeoutError
    got: list = []

    def run() -> None:
        try:
            got.append((True, call()))
        except Exception as e:  # noqa: BLE001 - raised again below
            got.append((False, e))

    t = threading.Thread(target=run, daemon=True)
    t.start()
    t.join(seconds)
    if not got:
        raise TimeoutError
    ok, x = got[0]
    if ok:
        return x
    raise x


class Streak:
    """Errors in a row, and the wait that they ask for; a success ends the row."""

    def __init__(self, rng: random.Random):
        self.errors, self.rng = 0, rng

    def seen(self, ok: bool) -> float:
        self.errors = 0 if ok else self.errors + 1
        return backoff(self.errors, self.rng)


def fetch_pages(addresses: DataFrame, fetch: Fetch, seconds: float = 15.0, wait: Callable[[float], None] | None = None, seed: int = 1) -> DataFrame:
    """addresses(url) -> (url, html), null where the page fails or takes too long. Between pages a task waits as its errors ask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        streak = Streak(random.Random(seed))
        for b in batches:
            pages = []
            for u in b["url"]:
                try:
                    page = within(lambda u=u: fetch(u), seconds)
                except Exception:  # noqa: BLE001 - a page that fails or comes too late is null
                    page = None
                pages.append(page)
                pause = streak.seen(pages[-1] is not None)
                if wait:
                    wait(pause)
            yield pd.DataFrame({"url": b["url"], "html": pages})

    return addresses.select("url").mapInPandas(run, "url string, html string")


def robots_table(hosts: DataFrame, fetch: Fetch, agent: str = "*") -> DataFrame:
    """hosts(host) -> (host, disallow, allow), each host's rules read once; unreadable ones allow everything."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for h in b["host"]:
                try:
                    rules = robots_rules(fetch(f"https://{h}/robots.txt"), agent)
                except Exception:  # noqa: BLE001 - unreadable allows everything
                    rules = ([], [])
                rows.append((h, *rules))
            yield pd.DataFrame(rows, columns=["host", "disallow", "allow"])

    return hosts.select("host").where("host <> ''").distinct().mapInPandas(run, "host string, disallow array<string>, allow array<string>")


def discover(addresses: DataFrame, fetch: Fetch, parse: Callable[[str | None], list[str]]) -> DataFrame:
    """addresses(source, address) -> (source, url, ord), one task's addresses fetched one after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s, a in zip(b["source"], b["address"]):
                try:
                    rows += [(s, u, i) for i, u in enumerate(parse(fetch(a)))]
                except Exception:  # noqa: BLE001 - one address' failure is no job's failure
                    continue
            yield pd.DataFrame(rows, columns=["source", "url", "ord"])

    return addresses.select("source", "address").mapInPandas(run, "source string, url string, ord long")


def robots_rules(text: str | None, agent: str = "*") -> tuple[list[str], list[str]]:
    """(disallow, allow) prefixes that hold for the agent; none for null, which allows everything."""
    rules: tuple[list[str], list[str]] = ([], [])
    mine = grouped = False
    for line in (text or "").splitlines():
        k, _, v = line.split("#")[0].partition(":")
        k, v = k.strip().lower(), v.strip()
        if k == "user-agent":
            mine = (mine and not grouped) or v == agent
            grouped = False
        elif k in ("disallow", "allow"):
            grouped = True
            if mine and v:
                rules[k == "allow"].append(v)
    return rules


def backoff(errors: int, rng: random.Random, low: float = 1.0, high: float = 3.0, most: float = 30.0) -> float:
    """Seconds to wait before the next page after so many errors in a row."""
    return min(rng.uniform(low, high) * 2**errors, most)


def retry_delay(attempt: int, message: str) -> float:
    """Seconds before a model call is tried again: a minute for exhausted quotas, else doubling."""
    m = message.lower()
    return 60.0 if "429" in m or "quota" in m else float(2 ** (attempt + 1))


def per_minute(delay: float) -> float:
    return 60.0 / delay if delay > 0 else float("inf")
