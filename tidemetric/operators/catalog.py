"""Catalog, provider and user-diversity metrics.

Impressions are reduced to one row per arm and content (or provider) first; windows and
zero-filling then run on catalog-sized tables. Arms are few, and their cross join with
the catalog only zero-fills what the catalog already bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemetric.operators.exposure import UNIT, exposed_events
from tidemetric.operators.inference import earlier_sums

ARM = "variant_id"


def impressions(events: DataFrame, users: DataFrame) -> DataFrame:
    """(variant_id, content_id, n) of exposed users' events with a content."""
    return exposed_events(events.filter(F.col("content_id").isNotNull()), users).groupBy("variant_id", "content_id").agg(F.count("*").alias("n"))


def provider_impressions(events: DataFrame, users: DataFrame, catalog: DataFrame) -> DataFrame:
    """(variant_id, provider_id, n): contents are counted first, then looked up in the catalog."""
    return impressions(events, users).join(catalog.select("content_id", "provider_id"), "content_id").groupBy("variant_id", "provider_id").agg(F.sum("n").alias("n"))


def coverage_rate(counts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Share of the catalog that each arm has shown."""
    shown = counts.join(catalog.select("content_id"), "content_id", "left_semi").groupBy("variant_id").agg(F.count_distinct("content_id").alias("shown"))
    size = catalog.agg(F.count_distinct("content_id").alias("size"))
    return shown.crossJoin(size).select("variant_id", F.try_divide("shown", "size").alias("metric_value"))


def zero_filled(counts: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Every arm with every item; 0 where the arm never showed it."""
    arms = counts.select("variant_id").distinct()
    return items.select(key).distinct().crossJoin(arms).join(counts, ["variant_id", key], "left").select("variant_id", key, F.coalesce("n", F.lit(0)).alias("n"))


def gini(counts: DataFrame, key: str) -> DataFrame:
    """Gini coefficient of n per arm: (2 Σ rank·n) / (N Σ n) - (N + 1) / N, ranks ascending.

    Equal values share their ranks' sum, so a row a distinct value is ranked, by ranges of the
    values; an arm's items are never sorted in one task.
    """
    levels = earlier_sums(counts.groupBy(ARM, "n").agg(F.count(key).alias("same")), [ARM], ["n"], "same")
    ranks = F.col("same") * F.col("sum_before") + F.col("same") * (F.col("same") + 1) / 2
    ranked = levels.groupBy(ARM).agg(F.sum(ranks * F.col("n")).alias("weighted"), F.sum(F.col("same") * F.col("n")).alias("total"), F.sum("same").alias("items"))
    value = F.try_divide(2.0 * F.col("weighted"), F.col("items") * F.col("total")) - (F.col("items") + 1.0) / F.col("items")
    return ranked.select("variant_id", F.coalesce(value, F.lit(0.0)).alias("metric_value"))


def catalog_gini(counts: DataFrame, catalog: DataFrame) -> DataFrame:
    return gini(zero_filled(counts, catalog, "content_id"), "content_id")


def provider_gini(counts: DataFrame, catalog: DataFrame) -> DataFrame:
    return gini(zero_filled(counts, catalog, "provider_id"), "provider_id")


def entropy(counts: DataFrame, keys: list[str]) -> DataFrame:
    """-Σ p ln p of n within ``keys``, as ln N - Σ n ln n / N."""
    n = F.col("n")
    return counts.filter("n > 0").groupBy(*keys).agg((F.ln(F.sum(n)) - F.sum(n * F.ln(n)) / F.sum(n)).alias("metric_value"))


def popularity(totals: DataFrame, n: str) -> DataFrame:
    """``totals`` with ``place``: percent rank of ``n``, largest first. Only distinct values are ranked, by ranges."""
    levels = earlier_sums(totals.groupBy(n).agg(F.count("*").alias("same")), [], [F.desc(n)], "same")
    size = totals.agg(F.count("*").alias("size"))
    placed = levels.crossJoin(F.broadcast(size)).select(n, F.coalesce(F.try_divide(F.col("sum_before"), F.col("size") - 1), F.lit(0.0)).alias("place"))
    return totals.join(placed, n)


def longtail_share(counts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Share of an arm's impressions on contents past ``threshold`` in the popularity order of all arms."""
    totals = counts.groupBy("content_id").agg(F.sum("n").alias("all"))
    tail = popularity(totals, "all").select("content_id", (F.col("place") >= threshold).alias("tail"))
    return counts.join(tail, "content_id").groupBy("variant_id").agg(F.try_divide(F.sum(F.when(F.col("tail"), F.col("n")).otherwise(0)), F.sum("n")).alias("metric_value"))


def provider_parity(counts: DataFrame) -> DataFrame:
    """Smallest provider share over the largest."""
    return counts.groupBy("variant_id").agg(F.try_divide(F.min("n").cast("double"), F.max("n")).alias("metric_value"))


def user_counts(events: DataFrame, users: DataFrame, catalog: DataFrame, field: str) -> DataFrame:
    """(user_id, variant_id, field, n) over the catalog's field (genre or provider)."""
    rows = exposed_events(events.filter(F.col("content_id").isNotNull()), users).join(catalog.select("content_id", field), "content_id")
    return rows.groupBy(*UNIT, field).agg(F.count("*").alias("n"))


def user_genre_entropy(events: DataFrame, users: DataFrame, catalog: DataFrame) -> DataFrame:
    return entropy(user_counts(events, users, catalog, "genre"), UNIT)


def user_provider_diversity(events: DataFrame, users: DataFrame, catalog: DataFrame) -> DataFrame:
    return user_counts(events, users, catalog, "provider_id").groupBy(*UNIT).agg(F.count("*").cast("double").alias("metric_value"))


def intra_list_distance(events: DataFrame, users: DataFrame, catalog: DataFrame, field: str = "genre") -> DataFrame:
    """1 - Σ p² over the field's shares."""
    n = F.col("n")
    return user_counts(events, users, catalog, field).groupBy(*UNIT).agg((1 - F.sum(n * n) / (F.sum(n) * F.sum(n))).alias("metric_value"))


def user_discovery_rate(events: DataFrame, users: DataFrame, start: str) -> DataFrame:
    """Share of the contents a user saw since the start that are new to them."""
    begin = F.to_date(F.lit(start))
    seen = events.filter(F.col("content_id").isNotNull()).groupBy("user_id", "content_id").agg(F.min("event_date").alias("first"), F.max("event_date").alias("last"))
    own = exposed_events(seen.filter(F.col("last") >= begin), users)
    return own.groupBy(*UNIT).agg(F.avg((F.col("first") >= begin).cast("double")).alias("metric_value"))
