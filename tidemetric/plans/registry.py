"""A registry of queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemetric.sources.views import SQL as VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def with_views(sql: str) -> str:
    """The experiment views before a SELECT, or before the views of its own that it starts with."""
    own = re.match(r"\s*WITH (RECURSIVE )?", sql)
    if own is None:
        return f"WITH {VIEWS}\n{sql}"
    return f"WITH {own[1] or ''}{VIEWS},\n{sql[own.end():]}"


def query(sql: str | None = None, views: bool = True) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) under its name, with DuckDB SQL over the experiment views."""

    def put(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            TWINS[function.__name__] = with_views(sql) if views else sql
        return function

    return put


def half_normal_sql(z: str) -> str:
    """P(0 < Z < |z|) as DuckDB SQL, by its series."""
    terms = f"list_sum(list_transform(generate_series(0, 150), lambda i: exp((2 * i + 1) * ln(greatest(abs({z}), 1e-300)) - lgamma(2 * i + 2) + i * ln(2) + lgamma(i + 1))))"
    return f"(exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {terms})"


def normal_cdf_sql(z: str) -> str:
    return f"(0.5 + sign({z}) * {half_normal_sql(z)})"


def t_two_sided_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t as DuckDB SQL: 1 - I_y(1/2, df/2) at y = t²/(df + t²), by its series."""
    y, b = f"(({t}) * ({t}) / (({df}) + ({t}) * ({t})))", f"(({df}) / 2.0)"
    terms = f"list_sum(list_transform(generate_series(0, 400), lambda i: exp(lgamma({b} + 0.5 + i) - lgamma({b} + 0.5) - lgamma(1.5 + i) + lgamma(1.5) + i * ln(greatest({y}, 1e-300)))))"
    front = f"exp(0.5 * ln(greatest({y}, 1e-300)) + {b} * ln(1 - {y}) + ln(2) - lgamma(0.5) - lgamma({b}) + lgamma({b} + 0.5))"
    return f"(1 - {front} * {terms})"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, so that two engines' last bits do not count."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])
