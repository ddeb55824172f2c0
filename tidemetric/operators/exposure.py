"""Exposed users and their joins with events: what every metric starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = ["user_id", "variant_id"]


def exposed_users(exposures: DataFrame, *more: str, experiment: str | None = None) -> DataFrame:
    """One row per user and variant (and ``more`` keys): smallest assignment probability, first exposure.

    A user exposed to two variants is a row under both. Partial aggregation makes the
    shuffle as small as the users, not the exposures.
    """
    rows = exposures if experiment is None else exposures.filter(F.col("experiment_id") == experiment)
    return rows.groupBy(*UNIT, *more).agg(F.min("assignment_probability").alias("assignment_probability"), F.min("event_timestamp").alias("first_exposure"))


def of_type(events: DataFrame, event_type: str | None, where: Column | None = None) -> DataFrame:
    """Events of one type (None: all) that satisfy ``where``."""
    rows = events if event_type is None else events.filter(F.col("event_type") == event_type)
    return rows if where is None else rows.filter(where)


def exposed_events(events: DataFrame, users: DataFrame, how: str = "inner", on: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Events ⋈ exposed users. ``how="left"`` keeps exposed users without events.

    Spark picks the strategy: a broadcast while the users' measured size allows, else a
    sort-merge join whose skewed keys adaptive execution splits.
    """
    return events.join(users, list(on)) if how == "inner" else users.join(events, list(on), "left")


def within_window(events: DataFrame, users: DataFrame, hours: int) -> DataFrame:
    """Exposed users with their events in [first exposure, first exposure + hours), left outer."""
    if hours <= 0:
        raise ValueError("the window must be positive")
    after = (F.col("event_timestamp") >= F.col("first_exposure")) & (F.col("event_timestamp") < F.col("first_exposure") + F.expr(f"INTERVAL {int(hours)} HOURS"))
    own = events.withColumnRenamed("user_id", "__user")
    return users.join(own, (F.col("user_id") == F.col("__user")) & after, "left").drop("__user")
