"""Configuration: groups of defaults chosen by a root, overridden by key=value strings."""

from __future__ import annotations

import re
from pathlib import Path

_FLOAT = re.compile(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$")


def value(text: str):
    """A YAML-like scalar; 2e-5 is a number here, as people mean it."""
    t = text.strip()
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    if t.lower() in ("null", "~", ""):
        return None
    if re.fullmatch(r"[+-]?\d+", t):
        return int(t)
    return float(t) if _FLOAT.match(t) else t.strip("'\"")


def load(directory: str) -> tuple[dict[str, str], dict[str, dict[str, dict]]]:
    """(root, groups) from a folder of YAML files: config.yaml names an option of each group, <group>/<option>.yaml holds it.

    The root is a mapping, or a list ``defaults`` of one-entry mappings; other entries of the list are passed over.
    """
    import yaml

    read = lambda p: yaml.load(p.read_text(encoding="utf-8"), Loader=yaml.BaseLoader) or {}  # noqa: E731 - all scalars as text, see value
    top = read(Path(directory) / "config.yaml")
    listed = top.get("defaults", [{k: v} for k, v in top.items()])
    root = {k: v for d in listed if isinstance(d, dict) for k, v in d.items() if isinstance(v, str)}
    return root, {g: {f.stem: read(f) for f in sorted((Path(directory) / g).glob("*.yaml"))} for g in root}


def _typed(v):
    if isinstance(v, dict):
        return {k: _typed(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_typed(x) for x in v]
    return value(v) if isinstance(v, str) else v


def compose(root: dict[str, str], groups: dict[str, dict[str, dict]], overrides: list[str] = ()) -> dict:
    """root names an option of each group; an override without a dot swaps the option, one with a dot sets a value."""
    chosen = dict(root)
    for o in overrides:
        k, _, v = o.partition("=")
        if k in groups:
            if v not in groups[k]:
                raise KeyError(f"{k} has no option {v}")
            chosen[k] = v
    cfg = {g: _typed(groups[g][o]) for g, o in chosen.items()}
    for o in overrides:
        k, _, v = o.partition("=")
        if k not in groups:
            at, parts = cfg, k.split(".")
            for p in parts[:-1]:
                at = at.setdefault(p, {})
            at[parts[-1]] = value(v)
    return cfg
