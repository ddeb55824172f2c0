"""Streaming ingest: validation, dedup, sessions, routing, guardrails and posteriors.

Every function takes and returns DataFrames that may be streams; the batch operators give
the same rows on the same input. One watermark per stream bounds state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemetric.functions.events import clamped, ebvs_detected, is_finite

LATENESS_HOURS = 24
DEDUP_HORIZON = "2 hours"


def read_events(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A stream of event files, or of a topic where the connector is installed (``fmt="kafka"``, JSON values)."""
    if fmt == "kafka":
        raw = spark.readStream.format("kafka").options(**options).load()
        return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e"), "timestamp").select("e.*", F.col("timestamp").alias("ingested_at"))
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def failure_reason(required: list[str], finite: list[str] = (), ranges: dict[str, tuple[float, float]] | None = None, time: str | None = None, now: Column | None = None) -> Column:
    """The first rule that a row breaks, or null: required text, finite numbers, ranges, ±24 h of ``now``."""
    rules = [(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", f"missing {c}") for c in required]
    rules += [(~is_finite(F.col(c)), f"{c} is not finite") for c in finite]
    rules += [(~F.col(c).between(low, high), f"{c} is out of range") for c, (low, high) in (ranges or {}).items()]
    if time is not None:
        bound = F.expr(f"INTERVAL {LATENESS_HOURS} HOURS")
        rules.append((F.col(time).isNull(), f"missing {time}"))
        rules.append((~F.col(time).between(now - bound, now + bound), f"{time} is too far off"))
    out = F.lit(None).cast("string")
    for broken, reason in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(True)), reason).otherwise(out)
    return out


def split_valid(batch: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reason)."""
    marked = batch.withColumn("reject_reason", reason)
    return marked.filter("reject_reason is null").drop("reject_reason"), marked.filter("reject_reason is not null")


def deduplicated(events: DataFrame, keys: list[str], time: str, horizon: str = DEDUP_HORIZON) -> DataFrame:
    """One row per key within the watermark: exact, and state goes after the horizon."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)


def playback_sessions(beats: DataFrame, gap_seconds: int = 30, lateness: str = "1 minute") -> DataFrame:
    """Heartbeats to playback sessions: a gap over ``gap_seconds`` per (user, device, content) closes one.

    Spark's session windows merge late beats into their session; a closed session leaves
    when the watermark passes it. Ordered measures fold over the session's sorted beats.
    """
    keys = ["user_id", "device_id", "content_id"]
    rows = beats.withWatermark("timestamp", lateness) if beats.isStreaming else beats
    gap = f"{gap_seconds} seconds 1 microsecond"
    beat = F.struct("timestamp", "event_id", "is_startup", "is_rebuffering", "current_bitrate_kbps", "current_resolution_height")
    grouped = rows.groupBy(*keys, F.session_window("timestamp", gap).alias("w")).agg(F.sort_array(F.collect_list(beat)).alias("b"))
    changes = lambda test: F.size(F.filter(F.sequence(F.lit(1), F.size("b") - 1), lambda i: test(F.get("b", i), F.get("b", i - 1))))
    many = F.size("b") > 1
    playing = F.get(F.filter("b", lambda x: ~x["is_startup"]), F.lit(0))["timestamp"]
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    first, last = F.get("b", F.lit(0))["timestamp"], F.get("b", F.size("b") - 1)["timestamp"]
    total = lambda f: F.aggregate("b", F.lit(0.0), lambda s, x: s + f(x))
    out = grouped.select(
        *keys, first.alias("session_start"),
        F.when(playing.isNotNull(), F.floor((micros(last) - micros(playing)) / 1000)).otherwise(0).cast("long").alias("playback_duration_ms"),
        F.when(playing.isNotNull(), F.floor((micros(playing) - micros(first)) / 1000)).otherwise(0).cast("long").alias("time_to_first_frame_ms"),
        (F.get("b", F.lit(0))["is_rebuffering"].cast("int") + F.when(many, changes(lambda x, p: x["is_rebuffering"] & ~p["is_rebuffering"])).otherwise(0)).cast("long").alias("rebuffer_count"),
        F.round(clamped(total(lambda x: x["is_rebuffering"].cast("double")) / F.size("b"), 0.0, 1.0), 6).alias("rebuffer_ratio"),
        F.round(total(lambda x: x["current_bitrate_kbps"].cast("double")) / F.size("b"), 6).alias("avg_bitrate_kbps"),
        F.when(many, changes(lambda x, p: x["current_resolution_height"] != p["current_resolution_height"])).otherwise(0).cast("long").alias("resolution_switches"),
        F.array_max(F.transform("b", lambda x: x["current_resolution_height"])).alias("peak_resolution_height"),
        F.when(playing.isNull(), 1.0).otherwise(0.0).alias("startup_failure_rate"), F.size("b").cast("long").alias("beats"),
    )
    return out.withColumn("ebvs_detected", ebvs_detected(F.col("playback_duration_ms"), F.col("time_to_first_frame_ms")))


def guardrail_windows(events: DataFrame, time: str, value: str, keys: list[str], width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Mean value per tumbling window and key, final once the watermark has passed the window."""
    rows = events.withWatermark(time, lateness) if events.isStreaming else events
    out = rows.groupBy(*keys, F.window(time, width).alias("w")).agg(F.avg(value).alias("current_value"), F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("check_time"), "current_value", "n")


def running_posteriors(rewards: DataFrame) -> DataFrame:
    """Thompson posteriors as a running aggregate, for update or complete mode."""
    return rewards.groupBy("experiment_id", "arm_id").agg((1 + F.sum("reward")).alias("alpha"), (1 + F.sum(1 - F.col("reward"))).alias("beta"), F.count("*").alias("pulls"))


def running_sums(obs: DataFrame, keys: list[str]) -> DataFrame:
    """The sums that the anytime-valid interval needs per key and arm, as a running aggregate."""
    x, y = F.col("x"), F.col("y")
    return obs.filter("y is not null").groupBy(*keys, "variant_id").agg(F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(x).alias("sx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"))


def moments_from_sums(sums: DataFrame) -> DataFrame:
    """n, means, variances and covariance from running sums, as ``inference.moments`` names them."""
    n = F.col("n")
    spread = lambda p, a, b: F.try_divide(F.col(p) - F.col(a) * F.col(b) / n, n - 1)
    keep = [c for c in sums.columns if c not in ("sy", "sx", "syy", "sxy", "sxx")]
    return sums.select(*keep, (F.col("sy") / n).alias("mean"), spread("syy", "sy", "sy").alias("var"), (F.col("sx") / n).alias("mean_x"), spread("sxx", "sx", "sx").alias("var_x"), spread("sxy", "sx", "sy").alias("cov"))


def routed_write(paths: dict[str, str], type_column: str = "event_type"):
    """A ``foreachBatch`` function that writes each event type to its own place; a batch that is redone replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for kind, path in paths.items():
            batch.filter(F.col(type_column) == kind).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    return write


def validating_write(valid_path: str, reject_path: str, reason: Column):
    """A ``foreachBatch`` function that splits a batch into valid rows and rejects with reasons."""

    def write(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_valid(batch.persist(), reason)
        good.write.mode("overwrite").parquet(f"{valid_path}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{reject_path}/batch={batch_id}")
        batch.unpersist()

    return write


def observed(events: DataFrame, event_time: str, arrival_time: str, reason: Column, name: str = "ingest") -> DataFrame:
    """Counts accepted and rejected rows and the mean delay as the stream runs, for a query listener."""
    delay = F.unix_micros(F.col(arrival_time).cast("timestamp")) - F.unix_micros(F.col(event_time).cast("timestamp"))
    return events.observe(name, F.count("*").alias("rows"), F.count(F.when(reason.isNull(), 1)).alias("accepted"), F.count(reason).alias("rejected"), (F.avg(delay) / 1e6).alias("mean_delay_seconds"))


def alert_messages(alerts: DataFrame) -> DataFrame:
    """Guardrail alerts as topic messages: key is the experiment, value is JSON. For a Kafka or file sink."""
    value = F.to_json(F.struct("experiment_id", "metric_id", "variant_id", F.col("check_time").alias("detected_at"), "current_value", F.col("run").alias("consecutive_breach_count")))
    return alerts.select(F.col("experiment_id").alias("key"), value.alias("value"))


def counting_write(path: str, reason: Column, event_time: str, arrival_time: str, type_column: str = "event_type"):
    """A ``foreachBatch`` function that counts rows and rejects per type and sums their delay; a batch that is redone replaces its part."""

    def write(batch: DataFrame, batch_id: int) -> None:
        delay = (F.unix_micros(F.col(arrival_time).cast("timestamp")) - F.unix_micros(F.col(event_time).cast("timestamp"))) / 1e6
        counts = batch.groupBy(type_column).agg(F.count("*").alias("rows"), F.count(reason).alias("rejected"), F.sum(delay).alias("delay"))
        counts.withColumn("accepted", F.lit(0).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def accepting_write(path: str, type_column: str = "event_type"):
    """A ``foreachBatch`` function that counts what deduplication has let through, per type."""

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(type_column).agg(F.count("*").alias("accepted"))
        counts.select(type_column, F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("rejected"), F.lit(0.0).alias("delay"), "accepted").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def count_stream(events: DataFrame, spark: SparkSession, folder: str, reason: Column, event_id: str, event_time: str, arrival_time: str, type_column: str = "event_type", horizon: str = DEDUP_HORIZON) -> DataFrame:
    """Totals per type (``total_counts``) of what a stream holds: rows, rejects, accepted and repeated ids, mean delay.

    Ids are state for ``horizon`` after they arrive, in Spark's store, and then go: the state
    is as large as that time's ids, however long the stream runs.
    """
    run_once(events, spark, f"{folder}/rows", write=counting_write(f"{folder}/counts/part=rows", reason, event_time, arrival_time, type_column))
    valid = deduplicated(events.filter(reason.isNull()), [type_column, event_id], arrival_time, horizon)
    run_once(valid, spark, f"{folder}/valid", write=accepting_write(f"{folder}/counts/part=valid", type_column))
    return total_counts(spark.read.parquet(f"{folder}/counts"), type_column)


def total_counts(counts: DataFrame, type_column: str = "event_type") -> DataFrame:
    """Totals over all batches: what is neither rejected nor accepted is a duplicate."""
    total = counts.groupBy(type_column).agg(*[F.sum(c).alias(c) for c in ("rows", "rejected", "accepted", "delay")])
    return total.select(type_column, "rows", "rejected", "accepted", (F.col("rows") - F.col("rejected") - F.col("accepted")).alias("duplicates"), (F.col("delay") / F.col("rows")).alias("mean_delay_seconds"))


def run_once(stream: DataFrame, spark: SparkSession, folder: str, mode: str = "append", write=None) -> DataFrame | None:
    """Drains what is there into Parquet under ``folder`` (or through ``write``) and reads it back.

    Complete mode has no file sink, so its last table is written per batch.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if write is not None:
        writer.foreachBatch(write).start().awaitTermination()
        return None
    if mode == "complete":
        writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out")).start().awaitTermination()
    else:
        writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
