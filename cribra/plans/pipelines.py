"""Jobs that join the operators: extract, label, filter, clean, split, export, train, compare."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribra.axes import AXES
from cribra.functions import responses, text, urls
from cribra.operators import ledger
from cribra.sources import html
from cribra.tables import materialize


class Judge(Protocol):
    """Answers texts with responses that hold JSON, or None; one instance per task."""

    def __call__(self, texts: list[str]) -> list[str | None]: ...


def ask(df: DataFrame, column: str, make_judge: Callable[[], Judge], name: str = "response") -> DataFrame:
    """Adds a judge's answers. Answers are costly and may differ when asked again, so they are written once."""
    schema = df.drop(name).schema.add(name, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make_judge()
        for b in batches:
            said = pa.array(judge([t or "" for t in b.column(column).to_pylist()]), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, said], [*b.schema.names, name])

    return materialize(df.drop(name).mapInArrow(run, schema), "answers")


class KeywordJudge:
    """A local stand-in for a model: scores by counts of given words. It claims no likeness to a real model."""

    def __init__(self, words: dict[str, tuple[str, ...]], political: tuple[str, ...] = ("congreso", "ley", "gobierno", "elecciones")):
        self.words, self.political = words, political

    def __call__(self, texts: list[str]) -> list[str | None]:
        import json

        out: list[str | None] = []
        for t in texts:
            low = t.lower()
            score = {a: min(100, 20 * sum(low.count(w) for w in self.words.get(a, ()))) for a in AXES}
            out.append(json.dumps({"is_political": int(any(w in low for w in self.political)), **score}))
        return out


class KeywordFilter:
    """A local stand-in for the article filter: the first category one of whose words stands in a text rejects it."""

    def __init__(self, words: dict[str, tuple[str, ...]]):
        self.words = words

    def __call__(self, texts: list[str]) -> list[str | None]:
        import json

        out: list[str | None] = []
        for t in texts:
            low = t.lower()
            found = next((c for c, ws in self.words.items() if any(w in low for w in ws)), None)
            out.append(json.dumps({"is_article": found is None, "category": found or "articulo", "reason": "" if found is None else "word"}))
        return out


def extract_articles(pages: DataFrame, known: DataFrame, least: int = 400) -> DataFrame:
    """pages(url, html, source, category, scraped_at) -> new articles with their hash, and only those.

    Short texts go before and after cleaning; then repeats of the ledger(url, content_hash) and of earlier pages.
    """
    art = pages.drop("html").join(html.extract_pages(pages), "url").where(F.length("text") >= least)
    art = text.barrier(art, "clean", text.clean_article(F.col("text"), F.col("authors"))).where(F.length("clean") >= least)
    art = art.drop("text").withColumnRenamed("clean", "text").withColumn("content_hash", F.md5("text"))
    return ledger.accept(art, known, ["scraped_at", "url"])


def clean_job(articles: DataFrame, noise: bool = True, least: int = 300) -> DataFrame:
    """articles -> the same with clean text, noise sections and short texts out."""
    df = articles.where(~urls.is_noise(F.col("url"))) if noise else articles
    df = text.barrier(df, "__clean", text.clean_article(F.col("text"), F.col("authors"))).where(F.length("__clean") >= least)
    return df.withColumn("text", F.col("__clean")).drop("__clean")


def label_job(articles: DataFrame, make_judge: Callable[[], Judge], chars: int = 8000) -> tuple[DataFrame, DataFrame]:
    """-> (labelled articles, dead letters with the response): what can't be used isn't lost and can be asked again."""
    a = ask(articles.withColumn("__prompt", text.prefix(F.col("text"), chars)), "__prompt", make_judge).drop("__prompt")
    a = responses.with_parsed(a, "response", responses.judge, "__p")
    n = responses.normalise(F.col("__p"))
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    good = a.where("__p IS NOT NULL").select(*[empty(c) for c in ("text", "title", "source", "category", "url")], "date", n.alias("__n")).select("text", "title", "source", "category", "url", "date", "__n.*")
    return good, a.where("__p IS NULL").drop("__p")


def filter_job(articles: DataFrame, make_judge: Callable[[], Judge], chars: int = 1500, least: int = 300) -> DataFrame:
    """Adds outcome (kept, error, too_short_after_clean or the verdict's category), reason and the clean text.

    Texts too short after cleaning aren't asked about.
    """
    df = text.barrier(articles, "__clean", text.clean_article(F.col("text")))
    short = df.where(F.coalesce(F.length("__clean"), F.lit(0)) < least).withColumns({"outcome": F.lit("too_short_after_clean"), "reason": F.lit(None).cast("string")})
    asked = ask(df.where(F.length("__clean") >= least).withColumn("__prompt", text.prefix(F.col("__clean"), chars)), "__prompt", make_judge).drop("__prompt")
    asked = responses.with_parsed(asked, "response", responses.verdict, "__p")
    asked = asked.withColumns({"outcome": F.when(F.col("__p").isNull(), "error").when(F.col("__p.is_article"), "kept").otherwise(F.col("__p.category")), "reason": F.col("__p.reason")}).drop("__p", "response")
    return short.unionByName(asked).withColumn("text", F.col("__clean")).drop("__clean")


def system_prompt(definitions: dict[str, dict], rules: list[str], examples: bool = False) -> str:
    """The judge's instruction: each axis with its definition, markers, scale and, if wanted, examples; then the rules.

    Entries that begin with [TBD are left out.
    """
    done = lambda xs: [x for x in xs if not str(x).startswith("[TBD")]
    out = ["# Axes"]
    for a in AXES:
        d = definitions.get(a, {})
        out += [f"\n## {a.upper()}", d.get("definition", "")]
        out += [f"- {m}" for m in done(d.get("markers", []))]
        out += [f"{k}: {v}" for k, v in sorted(d.get("scale", {}).items())]
        if examples:
            out += [f"{w}: {x}" for w in ("high", "low") for x in done(d.get(f"examples_{w}", []))]
    out += ["\n# Rules", *[f"{i}. {r}" for i, r in enumerate(done(rules), 1)], "\n# Answer", "One JSON object with is_political (0 or 1) and a score from 0 to 100 for: " + ", ".join(AXES)]
    return "\n".join(out)
