"""Runs metrics in dependency order and records what became of each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Step:
    """A metric: its id, the metrics it reads, and a function from their long rows to its own."""

    metric_id: str
    needs: tuple[str, ...]
    build: Callable[[DataFrame | None], DataFrame]


@dataclass
class Run:
    values: DataFrame | None
    status: dict[str, str] = field(default_factory=dict)


def run_metrics(steps: list[Step]) -> Run:
    """Operands before dependents. A metric whose operand failed, is missing or lies on a cycle is skipped.

    Building a plan is what can fail here; statuses are ok, failed: ..., or skipped: ....
    """
    known = {s.metric_id: s for s in steps}
    frames: dict[str, DataFrame] = {}
    status: dict[str, str] = {}
    waiting = dict(known)
    while waiting:
        ready = [s for s in waiting.values() if all(n in status or n not in known for n in s.needs)]
        if not ready:
            status |= {m: "skipped: cycle" for m in waiting}
            break
        for step in ready:
            del waiting[step.metric_id]
            lost = [n for n in step.needs if n not in frames]
            if lost:
                status[step.metric_id] = f"skipped: {', '.join(lost)}"
                continue
            try:
                inputs = reduce(DataFrame.unionByName, [frames[n] for n in step.needs]) if step.needs else None
                frames[step.metric_id] = step.build(inputs).select("user_id", "variant_id", F.lit(step.metric_id).alias("metric_id"), "metric_value")
                status[step.metric_id] = "ok"
            except Exception as error:  # a failed metric must not end the others
                status[step.metric_id] = f"failed: {type(error).__name__}"
    return Run(reduce(DataFrame.unionByName, frames.values()) if frames else None, status)
