"""Gap sessions and playback metrics, batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemetric.functions.events import clamped, ebvs_detected


def gap_sessions(events: DataFrame, keys: list[str], time: str, gap_seconds: int, tie: str) -> DataFrame:
    """Adds ``session_no`` per key: it rises where the gap to the event before is over ``gap_seconds``.

    Events are taken in order of (time, tie). One window over the keys; the key bounds a task.
    """
    order = Window.partitionBy(*keys).orderBy(time, tie)
    gap = F.expr(f"INTERVAL {int(gap_seconds)} SECOND")
    opens = F.coalesce((F.col(time) > F.lag(time).over(order) + gap).cast("int"), F.lit(0))
    return events.withColumn("opens", opens).withColumn("session_no", F.sum("opens").over(order)).drop("opens")


def playback_metrics(beats: DataFrame, gap_seconds: int = 30) -> DataFrame:
    """Heartbeats (user_id, device_id, content_id, timestamp, ...) to one row per playback session.

    duration, time to first frame (start of the session to the first beat that is not
    startup), rebuffer count (false to true) and ratio of beats, mean bitrate, resolution
    switches, peak resolution, startup failure (only startup beats) and EBVS. Values are
    clamped to their ranges; session_id is made from the key and session number.
    """
    keys = ["user_id", "device_id", "content_id"]
    rows = gap_sessions(beats, keys, "timestamp", gap_seconds, "event_id")
    own = Window.partitionBy(*keys, "session_no").orderBy("timestamp", "event_id")
    flagged = rows.withColumns({
        "stalls": (F.col("is_rebuffering") & ~F.coalesce(F.lag("is_rebuffering").over(own), F.lit(False))).cast("int"),
        "switches": (F.col("current_resolution_height") != F.coalesce(F.lag("current_resolution_height").over(own), F.col("current_resolution_height"))).cast("int"),
    })
    seconds = F.unix_micros(F.col("timestamp").cast("timestamp"))
    grouped = flagged.groupBy(*keys, "session_no").agg(
        F.min(seconds).alias("first"), F.max(seconds).alias("last"), F.min(F.when(~F.col("is_startup"), seconds)).alias("playing"),
        F.sum("stalls").alias("rebuffer_count"), F.avg(F.col("is_rebuffering").cast("double")).alias("ratio"),
        F.avg("current_bitrate_kbps").alias("avg_bitrate_kbps"), F.sum("switches").alias("resolution_switches"), F.max("current_resolution_height").alias("peak_resolution_height"), F.count("*").alias("beats"),
    )
    started = F.col("playing").isNotNull()
    out = grouped.select(
        *keys, "session_no",
        F.concat_ws("-", *keys, "session_no").alias("session_id"),
        F.when(started, F.floor((F.col("last") - F.col("playing")) / 1000)).otherwise(0).cast("long").alias("playback_duration_ms"),
        F.when(started, F.floor((F.col("playing") - F.col("first")) / 1000)).otherwise(0).cast("long").alias("time_to_first_frame_ms"),
        "rebuffer_count", F.round(clamped(F.col("ratio"), 0.0, 1.0), 6).alias("rebuffer_ratio"), F.round("avg_bitrate_kbps", 6).alias("avg_bitrate_kbps"),
        "resolution_switches", "peak_resolution_height", F.when(started, 0.0).otherwise(1.0).alias("startup_failure_rate"), "beats",
    )
    return out.withColumn("ebvs_detected", ebvs_detected(F.col("playback_duration_ms"), F.col("time_to_first_frame_ms")))
