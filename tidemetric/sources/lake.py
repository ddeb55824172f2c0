"""Typed readers of the lake tables. Filters name partition columns, so they prune files."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The lake's table schemas.
SCHEMAS = {
    "exposures": "event_id string, experiment_id string, user_id string, variant_id string, platform string, session_id string, assignment_probability double, interleaving_provenance map<string,string>, bandit_context_json string, lifecycle_segment string, event_timestamp timestamp, ingested_at timestamp, date_partition string",
    "metric_events": "event_id string, user_id string, event_type string, value double, content_id string, session_id string, properties map<string,string>, event_timestamp timestamp, ingested_at timestamp, date_partition string",
    "reward_events": "event_id string, experiment_id string, user_id string, arm_id string, reward double, context_json string, event_timestamp timestamp, date_partition string",
    "qoe_events": "event_id string, session_id string, content_id string, user_id string, time_to_first_frame_ms long, rebuffer_count int, rebuffer_ratio double, avg_bitrate_kbps int, resolution_switches int, peak_resolution_height int, startup_failure_rate double, playback_duration_ms long, ebvs_detected boolean, cdn_provider string, abr_algorithm string, encoding_profile string, event_timestamp timestamp, date_partition string",
    "content_catalog": "content_id string, provider_id string, title string, genre string, subgenre string, content_type string, duration_seconds long, release_year int, country_of_origin string, language string, is_original boolean, is_licensed boolean, popularity_rank long, updated_at timestamp",
    "interleaving_scores": "experiment_id string, user_id string, algorithm_scores map<string,double>, winning_algorithm_id string, total_engagements int, computation_date date",
    "content_consumption": "experiment_id string, variant_id string, content_id string, watch_time_seconds double, view_count long, unique_viewers long, computation_date date",
    "daily_treatment_effects": "experiment_id string, metric_id string, effect_date date, treatment_mean double, control_mean double, absolute_effect double, sample_size long",
    "experiment_level_metrics": "experiment_id string, variant_id string, metric_id string, metric_value double, computation_date date",
    "switchback_periods": "experiment_id string, metric_id string, period_id long, value double, is_treatment long",
    "synthetic_control_panel": "experiment_id string, metric_id string, unit_id string, period long, value double, is_treated_unit long, is_post_treatment long",
}


def read_table(spark: SparkSession, path: str, name: str, **only) -> DataFrame:
    """A lake table with its schema; keyword filters are equalities that reach the scan."""
    df = spark.read.schema(SCHEMAS[name]).parquet(path)
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == kv[1]), only.items(), df)


def read_metric_summaries(spark: SparkSession, path: str, experiment_id: str) -> DataFrame:
    """An experiment's summaries; optional columns that the files lack come as nulls.

    Segment, session and probability switch analyses on only where they are present.
    """
    df = spark.read.parquet(path).filter(F.col("experiment_id") == experiment_id)
    for name, kind in (("cuped_covariate", "double"), ("lifecycle_segment", "string"), ("session_id", "string"), ("assignment_probability", "double")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def read_daily_effects(spark: SparkSession, path: str, experiment_id: str, metric_id: str | None = None) -> DataFrame:
    """An experiment's daily effects for a metric, or for the one with most days."""
    df = read_table(spark, path, "daily_treatment_effects", experiment_id=experiment_id)
    if metric_id is not None:
        return df.filter(F.col("metric_id") == metric_id)
    days = df.groupBy("metric_id").agg(F.count("*").alias("days"))
    first = days.withColumn("n", F.row_number().over(Window.orderBy(F.desc("days"), "metric_id"))).filter("n = 1").select("metric_id")
    return df.join(F.broadcast(first), "metric_id")


def read_interleaving_scores(spark: SparkSession, path: str, experiment_id: str) -> DataFrame:
    """An experiment's scores, a row for each user and algorithm of the map."""
    df = read_table(spark, path, "interleaving_scores", experiment_id=experiment_id)
    return df.select("experiment_id", "user_id", "winning_algorithm_id", "total_engagements", "computation_date", F.explode("algorithm_scores").alias("algorithm", "score"))


def read_switchback_periods(spark: SparkSession, path: str, experiment_id: str, metric_id: str | None = None) -> DataFrame:
    """An experiment's block values with their place ``at`` in the order of blocks; a metric has few blocks."""
    df = read_table(spark, path, "switchback_periods", experiment_id=experiment_id)
    df = df if metric_id is None else df.filter(F.col("metric_id") == metric_id)
    return df.withColumn("at", F.row_number().over(Window.partitionBy("metric_id").orderBy("period_id")))


def split_consumption(consumption: DataFrame, control: str = "control") -> DataFrame:
    """Content with watch time of control and of all treatments side by side."""
    is_control = F.col("variant_id") == control
    return consumption.groupBy("content_id").agg(F.coalesce(F.sum(F.when(is_control, F.col("watch_time_seconds"))), F.lit(0.0)).alias("control_time"), F.coalesce(F.sum(F.when(~is_control, F.col("watch_time_seconds"))), F.lit(0.0)).alias("treatment_time"))


def synthetic_arms(users: DataFrame, kind: str, seed: int = 1) -> DataFrame:
    """Synthetic arms for ``users`` (user_id): half control, half treatment; normal, bernoulli or poisson values.

    Values come from hashes of the user id, so reruns agree however rows are dealt.
    """
    uniform = lambda salt: (F.pmod(F.xxhash64(F.lit(f"{salt}-{seed}"), "user_id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    gauss = F.sqrt(-2 * F.ln(uniform("radius"))) * F.cos(2 * math.pi * uniform("angle"))
    base = users.select("user_id", F.when(F.col("user_id") % 2 == 0, "control").otherwise("treatment").alias("variant_id"), uniform("u").alias("u"), gauss.alias("z"))
    treated = F.col("variant_id") == "treatment"
    if kind == "normal":
        value = F.when(treated, 10.0).otherwise(8.0) + 2.0 * F.col("z")
    elif kind == "bernoulli":
        value = (F.col("u") < F.when(treated, 0.6).otherwise(0.5)).cast("double")
    elif kind == "poisson":  # smallest k whose distribution function passes u
        rate = F.when(treated, 5.0).otherwise(3.0)
        terms = F.sequence(F.lit(0), F.lit(40))
        cdf = F.aggregate(terms, F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k")), lambda s, k: F.struct((s["p"] * rate / (k + 1)).alias("p"), (s["c"] + s["p"] * rate / (k + 1)).alias("c"), (s["k"] + (s["c"] < F.col("u")).cast("int")).alias("k")))
        value = cdf["k"].cast("double")
    else:
        raise ValueError(f"no such kind: {kind!r}")
    return base.select("user_id", "variant_id", value.alias("value"))
