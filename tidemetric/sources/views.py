"""Experiment views over the star-schema test tables, and the same views as SQL text.

Experiment ``exp`` starts on 2024-01-08: events before it are the pre-period, events from
then on are exposures too. Users fall into three arms by id. Views are lazy; a query
reads only the columns and dates that it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = "2024-01-08"
END = "2024-01-31"
# Lifecycle segments in order.
SEGMENTS = ("TRIAL", "NEW", "ESTABLISHED", "MATURE", "AT_RISK", "WINBACK")
#: Retraining of recommendation models: (id, day, share of training data from treatment).
RETRAININGS = (("r1", "2024-01-12", 0.1), ("r2", "2024-01-16", 0.3), ("r3", "2024-01-20", 0.2), ("r4", "2024-01-24", 0.4))

_VARIANT = "CASE user_id % 3 WHEN 0 THEN 'control' WHEN 1 THEN 't1' ELSE 't2' END"
_SEGMENT = "CASE user_id % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SEGMENTS)) + " END"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("content_id"),
        F.col("ts").alias("event_timestamp"), F.to_date("ts").alias("event_date"),
    )


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_events(spark, sf_dir).filter(F.col("event_timestamp") >= F.lit(START).cast("timestamp_ntz")).select(
        F.lit("exp").alias("experiment_id"), "event_id", "user_id",
        F.expr(_VARIANT).alias("variant_id"), (0.2 + 0.1 * (F.col("user_id") % 5)).alias("assignment_probability"),
        F.expr(_SEGMENT).alias("lifecycle_segment"), "event_timestamp", "event_date",
    )


def content_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("content_id"), F.col("p_brand").alias("provider_id"), F.col("p_type").alias("genre")
    )


def sessions(spark: SparkSession, sf_dir: str, gap_hours: int = 6) -> DataFrame:
    """Metric events with a session_id: a gap over ``gap_hours`` within a user starts a new one."""
    from tidemetric.operators.sessions import gap_sessions

    return gap_sessions(metric_events(spark, sf_dir), ["user_id"], "event_timestamp", gap_hours * 3600, "event_id")


def qoe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("content_id")
    base = metric_events(spark, sf_dir).filter(F.col("event_type").isin("view", "error")).select(
        "event_id", "user_id", "content_id", "event_timestamp", "event_date",
        F.floor(F.col("value") * 100).cast("long").alias("time_to_first_frame_ms"),
        F.when(F.col("event_type") == "error", 0).otherwise(F.floor(F.col("value") * 1000)).cast("long").alias("playback_duration_ms"),
        ((k % 10) / 10.0).alias("rebuffer_ratio"), (1000 + 10 * k).alias("avg_bitrate_kbps"),
    )
    from tidemetric.functions.events import ebvs_detected

    return base.withColumn("ebvs_detected", ebvs_detected(F.col("playback_duration_ms"), F.col("time_to_first_frame_ms")))


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("content_id")
    return metric_events(spark, sf_dir).select(
        "event_id", "user_id", (F.col("user_id") % 2).alias("device_id"), "content_id", F.col("event_timestamp").alias("timestamp"),
        (F.col("event_type") == "signup").alias("is_startup"), (F.col("event_type") == "error").alias("is_rebuffering"),
        (1000 + 10 * k).alias("current_bitrate_kbps"), F.element_at(F.array(F.lit(480), F.lit(720), F.lit(1080)), k % 3 + 1).alias("current_resolution_height"),
    )


def reward_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("content_id")
    return metric_events(spark, sf_dir).filter(F.col("event_type").isin("click", "purchase")).select(
        "event_id", F.lit("exp").alias("experiment_id"), "user_id", (k % 4).alias("arm_id"), F.when(F.col("value") > 20, 1.0).otherwise(0.0).alias("reward"),
        F.array(F.lit(1.0), k / 100.0, (F.col("value") > 50).cast("double")).alias("context"), "event_timestamp",
        (k % 5).alias("position"), (0.05 + 0.01 * (k % 5)).alias("propensity"),
    )


def model_retraining_events(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(a, b, c, ["exp"]) for a, b, c in RETRAININGS], "retraining_event_id string, day string, treatment_contamination_fraction double, active_experiment_ids array<string>")
    return rows.withColumn("retrained_on", F.to_date("day")).drop("day")


def metric_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day the mean value over exposed days; the covariate is the pre-period mean, else 0."""
    events = metric_events(spark, sf_dir)
    pre = events.filter(F.col("event_date") < F.lit(START).cast("date")).groupBy("user_id").agg(F.avg("value").alias("cuped_covariate"))
    exposed = exposures(spark, sf_dir).groupBy("user_id", "variant_id", "lifecycle_segment").agg(F.min("assignment_probability").alias("assignment_probability"))
    days = events.filter(F.col("event_date") >= F.lit(START).cast("date")).groupBy("user_id", "event_date").agg(F.avg("value").alias("metric_value"))
    return days.join(exposed, "user_id").join(pre, "user_id", "left").select(
        F.lit("exp").alias("experiment_id"), "user_id", "variant_id", F.lit("value").alias("metric_id"), "lifecycle_segment",
        "metric_value", F.coalesce("cuped_covariate", F.lit(0.0)).alias("cuped_covariate"), "assignment_probability", F.col("event_date").alias("computation_date"),
    )


SQL = f"""
metric_events AS (SELECT event_id, user_id, event_type, value, CAST(props->>'$.k' AS INT) AS content_id, ts AS event_timestamp, CAST(ts AS DATE) AS event_date FROM events),
exposures AS (SELECT 'exp' AS experiment_id, event_id, user_id, {_VARIANT} AS variant_id, 0.2::double + 0.1::double * (user_id % 5) AS assignment_probability,
  {_SEGMENT} AS lifecycle_segment, event_timestamp, event_date FROM metric_events WHERE event_timestamp >= TIMESTAMP '{START}'),
eu AS (SELECT user_id, variant_id, min(assignment_probability) AS assignment_probability, min(event_timestamp) AS first_exposure FROM exposures GROUP BY user_id, variant_id),
content_catalog AS (SELECT p_partkey::int AS content_id, p_brand AS provider_id, p_type AS genre FROM part),
qoe_base AS (SELECT event_id, user_id, content_id, event_timestamp, event_date, floor(value * 100)::bigint AS time_to_first_frame_ms,
  (CASE WHEN event_type = 'error' THEN 0 ELSE floor(value * 1000) END)::bigint AS playback_duration_ms, (content_id % 10) / 10.0 AS rebuffer_ratio, 1000 + 10 * content_id AS avg_bitrate_kbps
  FROM metric_events WHERE event_type IN ('view', 'error')),
qoe_events AS (SELECT *, playback_duration_ms <= 0 AND (time_to_first_frame_ms <= 0 OR time_to_first_frame_ms > 10000) AS ebvs_detected FROM qoe_base),
gaps AS (SELECT *, CASE WHEN event_timestamp > lag(event_timestamp) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS opens FROM metric_events WINDOW w AS (PARTITION BY user_id ORDER BY event_timestamp, event_id)),
sessions AS (SELECT * EXCLUDE (opens), sum(opens) OVER (PARTITION BY user_id ORDER BY event_timestamp, event_id)::bigint AS session_no FROM gaps),
summaries AS (SELECT d.user_id, eu.variant_id, d.event_date AS computation_date, d.metric_value, coalesce(p.x, 0) AS cuped_covariate, eu.assignment_probability,
  {_SEGMENT.replace("user_id", "d.user_id")} AS lifecycle_segment
  FROM (SELECT user_id, event_date, avg(value) AS metric_value FROM metric_events WHERE event_date >= DATE '{START}' GROUP BY 1, 2) d
  JOIN eu USING (user_id) LEFT JOIN (SELECT user_id, avg(value) AS x FROM metric_events WHERE event_date < DATE '{START}' GROUP BY 1) p USING (user_id)),
retrainings AS (SELECT id AS retraining_event_id, CAST(day AS DATE) AS retrained_on, share FROM (VALUES {", ".join(f"('{a}', '{b}', {c})" for a, b, c in RETRAININGS)}) t(id, day, share))"""
