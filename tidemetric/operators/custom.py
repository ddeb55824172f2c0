"""Read-only custom SQL metrics over named views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Words that a metric query may not hold.
REFUSED = ("alter", "call", "create", "delete", "drop", "grant", "insert", "merge", "replace", "revoke", "set", "truncate", "update", "use")


def checked_select(sql: str) -> str:
    """The text if it is one SELECT or WITH without statements that change anything."""
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`", "''", re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.DOTALL)).strip().rstrip(";")
    if not re.match(r"(?i)(select|with)\b", bare) or ";" in bare:
        raise ValueError("a custom metric is one SELECT or WITH query")
    if found := re.search(r"(?i)\b(" + "|".join(REFUSED) + r")\b(?!\s*\()", bare):
        raise ValueError(f"a custom metric does not {found[0].lower()}")
    return sql.strip().rstrip(";")


def custom_metric(spark: SparkSession, sql: str, views: dict[str, DataFrame], users: DataFrame) -> DataFrame:
    """Rows (user_id, metric_value) of a user's query over ``views``, joined to exposed users."""
    return spark.sql("SELECT * FROM (" + _named(checked_select(sql), views) + ")", **{f"v_{k}": v for k, v in views.items()}).join(users, "user_id")


def _named(sql: str, views: dict[str, DataFrame]) -> str:
    for name in views:
        sql = re.sub(rf"\b{re.escape(name)}\b", f"{{v_{name}}}", sql)
    return sql
