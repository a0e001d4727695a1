"""Pages to articles: main text, title, authors, date and links, by the standard library's parser in Arrow batches.

Script, style, navigation, asides, footers and forms are left out; an article or main element is the text if there is
one, else the whole body; block elements end a line; entities are decoded; unclosed tags don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

SKIP = frozenset("script style noscript nav aside footer header form button svg iframe template table figure".split())
VOID = frozenset("br hr img input link meta area base col embed source track wbr".split())
BLOCK = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 article section main blockquote tr td pre hr".split())
MAIN = frozenset(("article", "main"))


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip: list[str] = []
        self.main = 0
        self.in_title = False
        self.parts: list[str] = []
        self.main_parts: list[str] = []
        self.title: list[str] = []
        self.meta: dict[str, str] = {}
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.meta.setdefault((a.get("name") or a.get("property") or "").lower(), a.get("content", ""))
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag == "title":
            self.in_title = True
        if tag in SKIP:
            self.skip.append(tag)
        if tag in MAIN:
            self.main += 1
        if tag in BLOCK:
            self._add("\n")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.skip:
            del self.skip[len(self.skip) - 1 - self.skip[::-1].index(tag) :]
        if tag in BLOCK:
            self._add("\n")
        if tag in MAIN and self.main:
            self.main -= 1

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skip:
            self._add(data)

    def _add(self, s: str) -> None:
        self.parts.append(s)
        if self.main:
            self.main_parts.append(s)


def _lines(parts: list[str]) -> str:
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(parts).split("\n")) if x)


def extract(html: str | None) -> tuple[str, str, list[str], str | None, list[str]]:
    """(text, title, authors, date, links) of a page; all empty for null or empty."""
    p = _Page()
    try:
        p.feed(html or "")
        p.close()
    except (AssertionError, ValueError):
        pass  # what was read before the damage stands
    text = _lines(p.main_parts) or _lines(p.parts)
    title = p.meta.get("og:title") or " ".join("".join(p.title).split())
    authors = [x.strip() for x in (p.meta.get("author") or p.meta.get("article:author") or "").split(";") if x.strip()]
    return text, title, authors, p.meta.get("article:published_time") or p.meta.get("date") or None, p.links


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> (url, text, title, authors, date)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [extract(h)[:4] for h in b["html"]]
            yield pd.DataFrame({"url": b["url"], **{k: [g[i] for g in got] for i, k in enumerate(("text", "title", "authors", "date"))}})

    return pages.select("url", "html").mapInPandas(run, "url string, text string, title string, authors array<string>, date string")


def page_links(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> (url, ord, link): absolute http links in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(u, i, x) for u, h in zip(b["url"], b["html"]) for i, x in enumerate(urljoin(u or "", k) for k in extract(h)[4]) if x.startswith(("http://", "https://"))]
            yield pd.DataFrame(rows, columns=["url", "ord", "link"])

    return pages.select("url", "html").mapInPandas(run, "url string, ord int, link string")
