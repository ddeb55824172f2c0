"""All registered queries of the experimentation operators, with their DuckDB twins."""

from __future__ import annotations

from tidemetric.plans import analysis_queries, building_blocks, inference_queries, metric_queries, stream_queries  # noqa: F401  each module registers its own
from tidemetric.plans.registry import QUERIES, TWINS, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(TWINS)
