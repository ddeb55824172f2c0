"""Bulk assignment of users to experiments, and switchback designs.

Experiments are configuration: a short list that becomes columns or a small broadcast
table. Users are hashed once per experiment, in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemetric.functions.murmur import bucket_of
from tidemetric.functions.predicates import targeting


@dataclass
class Experiment:
    """Buckets [first, last] of a layer, both inclusive, and (variant, traffic fraction) in order."""

    experiment_id: str
    salt: str
    first: int
    last: int
    variants: list[tuple[str, float]]
    layer: str = "default"
    buckets: int = 10_000
    is_holdout: bool = False
    rules: list[list[tuple[str, str, list[str]]]] = field(default_factory=list)


def variant_of(bucket: Column, experiment: Experiment) -> Column:
    """The variant whose cumulative share of the bucket range holds the bucket; the last takes what rounding leaves."""
    width = experiment.last - experiment.first + 1
    inside = (bucket >= experiment.first) & (bucket <= experiment.last)
    place = (bucket - experiment.first) / float(width)
    chain, edge = None, 0.0
    for name, fraction in experiment.variants[:-1]:
        edge += fraction
        chain = F.when(place < edge, name) if chain is None else chain.when(place < edge, name)
    last = F.lit(experiment.variants[-1][0])
    return F.when(inside, last if chain is None else chain.otherwise(last))


def assign_variants(users: DataFrame, experiment: Experiment, unit: Column | None = None, attributes: Column | None = None) -> DataFrame:
    """Users with bucket and variant_id (null: not in the experiment). Targeting needs ``attributes``."""
    hashed = users.withColumn("bucket", bucket_of(F.col("user_id") if unit is None else unit, experiment.salt, experiment.buckets))
    variant = variant_of(F.col("bucket"), experiment)
    if experiment.rules:
        variant = F.when(targeting(attributes, experiment.rules), variant)
    return hashed.withColumn("variant_id", variant)


def session_unit(cross_session: bool) -> Column:
    """What is hashed: the session, or the user where an assignment must not change between sessions."""
    return F.col("session_id") if cross_session else F.col("user_id").cast("string")


def assign_all(users: DataFrame, experiments: list[Experiment], attributes: Column | None = None) -> DataFrame:
    """(user_id, experiment_id, layer, variant_id): holdouts first, and they claim their layer."""
    from functools import reduce

    def one(e: Experiment) -> DataFrame:
        got = assign_variants(users, e, attributes=attributes).filter("variant_id is not null")
        return got.select("user_id", F.lit(e.experiment_id).alias("experiment_id"), F.lit(e.layer).alias("layer"), "variant_id")

    holdouts = [one(e) for e in experiments if e.is_holdout]
    others = [one(e) for e in experiments if not e.is_holdout]
    held = reduce(DataFrame.unionByName, holdouts) if holdouts else None
    rest = reduce(DataFrame.unionByName, others) if others else None
    if held is None or rest is None:
        return rest if held is None else held
    return held.unionByName(rest.join(held.select("user_id", "layer").distinct(), ["user_id", "layer"], "left_anti").select("user_id", "experiment_id", "layer", "variant_id"))


def parity_audit(assigned: DataFrame, logged: DataFrame) -> DataFrame:
    """Logged exposures (user_id, experiment_id, variant_id) against derived ones: rows and mismatches per experiment."""
    own = logged.groupBy("experiment_id", "user_id", "variant_id").agg(F.count("*").alias("rows"))
    derived = assigned.select("experiment_id", "user_id", F.col("variant_id").alias("expected"))
    joined = own.join(derived, ["experiment_id", "user_id"], "left")
    wrong = F.col("expected").isNull() | (F.col("expected") != F.col("variant_id"))
    return joined.groupBy("experiment_id").agg(F.sum("rows").alias("exposures"), F.sum(F.when(wrong, F.col("rows")).otherwise(0)).alias("mismatches"))


def switchback_blocks(events: DataFrame, time: str, block_seconds: int, washout_seconds: int, design: str = "alternating", cluster: Column | None = None, salt: str = "") -> DataFrame:
    """Adds block index, washout flag and arm (0 or 1): alternating, balanced (clusters start in turn) or randomized."""
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000
    out = events.withColumn("block", F.floor(seconds / block_seconds).cast("long"))
    out = out.withColumn("washout", seconds - F.col("block") * block_seconds < washout_seconds)
    if design == "alternating":
        arm = F.pmod("block", F.lit(2))
    elif design == "balanced":
        arm = F.pmod(F.col("block") + bucket_of(cluster, salt, 2), F.lit(2))
    elif design == "randomized":
        arm = bucket_of(F.concat_ws("|", cluster if cluster is not None else F.lit(""), F.col("block")), salt, 2)
    else:
        raise ValueError(f"no such design: {design!r}")
    return out.withColumn("arm", arm.cast("int"))
