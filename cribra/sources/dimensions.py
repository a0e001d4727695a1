"""Small dimensions that a caller keeps in files: source catalogue, encoder registry, codebook."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from cribra.axes import AXES
from cribra.sources.config import _typed

CATALOGUE = "name string, url string, category string, mode string, url_filters array<string>, rss_feeds array<string>"


def load(path: str):
    """The content of a JSON or YAML file, scalars typed as in configurations."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return _typed(yaml.load(text, Loader=yaml.BaseLoader))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A file of name: {url, category, mode, url_filters, rss_feeds} as a table; missing lists are empty."""
    rows = [(n, d.get("url"), d.get("category"), d.get("mode"), list(d.get("url_filters") or []), list(d.get("rss_feeds") or [])) for n, d in (load(path) or {}).items()]
    return spark.createDataFrame(rows, CATALOGUE)


def encoders(path: str, only: list[str] | None = None, skip: list[str] = ()) -> dict[str, str]:
    """A file of alias: model, those asked for in the file's order; an unknown alias is an error."""
    known = load(path) or {}
    if missing := [a for a in only or [] if a not in known]:
        raise KeyError(f"unknown: {', '.join(missing)}; there are {', '.join(known)}")
    return {a: m for a, m in known.items() if (not only or a in only) and a not in skip}


def codebook(path: str) -> tuple[dict[str, dict], list[str]]:
    """(definitions by axis, rules) of a file {axes: {...}, rules: [...]}, as pipelines.system_prompt takes them; every axis must be there."""
    d = load(path) or {}
    if missing := [a for a in AXES if a not in d.get("axes", {})]:
        raise ValueError(f"axes without an entry: {', '.join(missing)}")
    return {a: d["axes"][a] for a in AXES}, list(d.get("rules") or [])
