"""Small results as text: comparison reports and chart data. Inputs are aggregates of runs x axes rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribra.axes import AXES
from cribra.operators import evaluation

PALETTE = ("#4C72B0", "#DD8452", "#55A868", "#C44E52", "#8172B3")


def markdown(summary: DataFrame, encoders: DataFrame, decimals: int = 3) -> str:
    """A comparison of encoders: runs, means, winners, ranks."""
    ranked = evaluation.ranks(summary)
    by = {(r["encoder"], r["axis"]): r for r in ranked.collect()}
    best = {r["axis"]: r for r in evaluation.winners(summary).collect()}
    means = sorted(evaluation.mean_ranks(ranked).collect(), key=lambda r: (r["mean_rank"], r["encoder"]))
    names = sorted({e for e, _ in by})

    def show(m, s):
        if m is None:
            return "-"
        return f"{m:.{decimals}f}" if not s else f"{m:.{decimals}f} ± {s:.{decimals}f}"

    out = ["# Comparison", "", "| encoder | model | seeds | minutes | loss |", "|-|-|-|-|-|"]
    out += [f"| {r['encoder']} | {r['model_name']} | {r['seeds']} | {show(r['minutes_mean'], r['minutes_std'])} | {show(r['loss_mean'], r['loss_std'])} |" for r in encoders.orderBy("encoder").collect()]
    for key, title in (("r2", "R²"), ("mse", "MSE")):
        out += ["", f"## {title}", "", "| axis | " + " | ".join(names) + " | best |", "|-" * (len(names) + 2) + "|"]
        out += [f"| {a} | " + " | ".join(show(by[e, a][f"{key}_mean"], by[e, a][f"{key}_std"]) if (e, a) in by else "-" for e in names) + f" | {best[a][f'best_{key}'] if a in best else '-'} |" for a in AXES]
    out += ["", "## Ranks", "", "| encoder | wins | mean rank | macro R² | macro MSE |", "|-|-|-|-|-|"]
    out += [f"| {r['encoder']} | {r['wins']} | {r['mean_rank']:.2f} | {show(r['macro_r2'], 0)} | {show(r['macro_mse'], 0)} |" for r in means]
    return "\n".join(out) + "\n"


def bars(summary: DataFrame, metric: str) -> DataFrame:
    """(axis_pos, axis, encoder, mean, std, color) for grouped bars."""
    pos = F.element_at(F.create_map(*[x for i, a in enumerate(AXES) for x in (F.lit(a), F.lit(i))]), F.col("axis"))
    names = [r[0] for r in summary.select("encoder").distinct().orderBy("encoder").collect()]
    color = F.element_at(F.create_map(*[x for i, e in enumerate(names) for x in (F.lit(e), F.lit(PALETTE[i % len(PALETTE)]))]), F.col("encoder"))
    return summary.select(pos.alias("axis_pos"), "axis", "encoder", F.col(f"{metric}_mean").alias("mean"), F.col(f"{metric}_std").alias("std"), color.alias("color"))


def radar_svg(results: dict[str, dict[str, float]], size: int = 480) -> str:
    """Closed polygons of scores 0-100 over the axes, without any plotting library; a missing axis is 0."""
    c, r = size / 2, size * 0.4
    ang = evaluation.angles(len(AXES))
    at = lambda i, v: f"{c + r * v / 100 * math.sin(ang[i]):.1f},{c - r * v / 100 * math.cos(ang[i]):.1f}"
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}">']
    out += [f'<polygon points="{" ".join(at(i, v) for i in range(len(AXES)))}" fill="none" stroke="#ccc"/>' for v in (25, 50, 75, 100)]
    for k, (name, axes) in enumerate(results.items()):
        color = PALETTE[k % len(PALETTE)]
        out.append(f'<polygon points="{" ".join(at(i, axes.get(a, 0)) for i, a in enumerate(AXES))}" fill="{color}33" stroke="{color}"><title>{name}</title></polygon>')
    out += [f'<text x="{at(i, 112).split(",")[0]}" y="{at(i, 112).split(",")[1]}" text-anchor="middle" font-size="11">{a}</text>' for i, a in enumerate(AXES)]
    return "\n".join([*out, "</svg>"])


def write_sheets(sheet: DataFrame, summary: DataFrame, path: str) -> None:
    """The export workbook as folders of CSV: RESUMEN and one per axis, names in capitals of at most 31 signs."""
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/RESUMEN")
    for a in AXES:
        sheet.where(F.col("ideology") == f"[{a.upper()}]").orderBy("rank").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{a.upper()[:31]}")  # top-n rows
