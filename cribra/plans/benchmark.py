"""Runs of models x seeds: order, selection, failures."""

from __future__ import annotations

import contextlib
import io
import logging
import os
import subprocess
import time
import traceback
from collections.abc import Callable

log = logging.getLogger(__name__)


def plan(models: list[str], seeds: list[int], skip: list[str] = ()) -> list[tuple[str, int]]:
    """Seeds outside, models inside, skipped models left out, order kept."""
    return [(m, s) for s in seeds for m in models if m not in skip]


#: Lines of a failed run's output that are kept.
TAIL = 20


def run_all(runs: list[tuple[str, int]], train: Callable[[str, int], dict], go_on: bool = False, logs: str | None = None) -> list[dict]:
    """Metrics of each run, with its seconds; the first failure ends the series unless go_on.

    What a run prints or logs is kept for itself, in <logs>/<run>.log if a folder is named; a failure has its last TAIL lines.
    """
    out = []
    for m, s in runs:
        began, said = time.time(), io.StringIO()
        run = f"{m}__seed{s}"
        handler = logging.StreamHandler(said)
        logging.getLogger().addHandler(handler)
        try:
            with contextlib.redirect_stdout(said):
                out.append({"run": run, "encoder_alias": m, "seed": s, **train(m, s), "train_duration_seconds": time.time() - began})
        except Exception as e:  # noqa: BLE001 - the series decides
            said.write(traceback.format_exc())
            tail = said.getvalue().splitlines()[-TAIL:]
            log.error("run %s seed %s failed: %s", m, s, e)
            out.append({"run": run, "encoder_alias": m, "seed": s, "error": str(e), "tail": tail})
            if not go_on:
                break
        finally:
            logging.getLogger().removeHandler(handler)
            if logs:
                os.makedirs(logs, exist_ok=True)
                with open(os.path.join(logs, f"{run}.log"), "w", encoding="utf-8") as f:
                    f.write(said.getvalue())
    return out


def precision(wanted: str, capability: int | None) -> str:
    """auto takes bf16 from capability 8 on, fp16 on older accelerators, fp32 without one."""
    if wanted != "auto":
        return wanted
    return "fp32" if capability is None else "bf16" if capability >= 8 else "fp16"


def git_short_hash() -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=5, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None
