"""Ordered rule lists by incremental reduced-error pruning, exported as a SQL CASE expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Test:
    column: str
    op: str
    threshold: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.column]
        return v <= self.threshold if self.op == "<=" else v >= self.threshold

    def sql(self) -> str:
        return f"{self.column} {self.op} {self.threshold!r}D"


Rule = tuple[Test, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    m = np.ones(len(next(iter(x.values()))), bool)
    for t in rule:
        m &= t.mask(x)
    return m


def _grow(x: dict[str, np.ndarray], y: np.ndarray, most_tests: int) -> Rule:
    """Add the test of the largest information gain until no negative is covered or nothing is gained."""
    rule: Rule = ()
    m = np.ones(len(y), bool)
    while len(rule) < most_tests and (m & ~y).any():
        p, n = (m & y).sum(), (m & ~y).sum()
        if not p:
            break
        before, best, gain = np.log2(p / (p + n)), None, 1e-9
        for c in x:
            v = x[c][m]
            cuts = np.unique(v)
            cuts = (cuts[1:] + cuts[:-1]) / 2
            if len(cuts) > 64:
                cuts = np.quantile(v, np.linspace(0.01, 0.99, 64))
            for cut in np.unique(np.round(cuts, 4)):
                for op in ("<=", ">="):
                    k = v <= cut if op == "<=" else v >= cut
                    pk, nk = (k & y[m]).sum(), (k & ~y[m]).sum()
                    if pk and (g := pk * (np.log2(pk / (pk + nk)) - before)) > gain:
                        best, gain = Test(c, op, float(cut)), g
        if best is None:
            break
        rule += (best,)
        m &= best.mask(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    """Drop last tests as long as (p - n) / (p + n) on the pruning rows doesn't fall."""

    def worth(r: Rule) -> float:
        m = covers(r, x)
        p, n = (m & y).sum(), (m & ~y).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def induce(x: dict[str, np.ndarray], y: np.ndarray, seed: int = 7, most_rules: int = 12, most_tests: int = 4) -> list[Rule]:
    """Rules for y in the order in which they were found. Two thirds of the rows grow a rule, one third prunes it."""
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    left = np.ones(len(y), bool)
    while (left & y).sum() >= 2 and len(rules) < most_rules:
        idx = rng.permutation(np.flatnonzero(left))
        cut = max(1, 2 * len(idx) // 3)
        at = lambda i: {c: v[i] for c, v in x.items()}
        g, q = idx[:cut], idx[cut:]
        rule = _grow(at(g), y[g], most_tests)
        if not rule:
            break
        rule = _prune(rule, at(q), y[q]) if len(q) else rule
        m = covers(rule, at(q)) if len(q) else covers(rule, at(g))
        yy = y[q] if len(q) else y[g]
        if (m & ~yy).sum() > (m & yy).sum() or not (covers(rule, x) & left & y).any():
            break
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def to_case(rules: list[Rule]) -> str:
    """CASE expression: number of the first rule that fires (from 1), 0 if none does."""
    if not rules:
        return "0"
    return "CASE " + " ".join(f"WHEN {' AND '.join(t.sql() for t in r)} THEN {i}" for i, r in enumerate(rules, 1)) + " ELSE 0 END"
