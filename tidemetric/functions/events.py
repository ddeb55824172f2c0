"""Column rules on events: early-exit detection, clamping, validity and map checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_START_MS = 10_000


def ebvs_detected(playback_ms: Column, first_frame_ms: Column) -> Column:
    """Exit before video start: no playback, and no first frame or one after 10 s. Negative counts as 0; null as 0."""
    play, start = F.coalesce(playback_ms, F.lit(0)), F.coalesce(first_frame_ms, F.lit(0))
    return (play <= 0) & ((start <= 0) | (start > MOST_START_MS))


def clamped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def sound_map(entries: Column) -> Column:
    """A map without empty keys or values; a null map is sound."""
    return F.coalesce(F.forall(F.map_entries(entries), lambda e: (e["key"] != "") & e["value"].isNotNull() & (e["value"] != "")), F.lit(True))


def json_features(context: Column) -> Column:
    """JSON object text as a map of doubles; null where it is none."""
    return F.from_json(context, "map<string,double>")
