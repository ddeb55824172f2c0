"""Per-user metrics and their follow-ups, as DataFrame aggregations.

``users`` is the result of ``exposed_users``; ``events`` are metric events. Unless a
docstring says otherwise a metric returns user_id, variant_id, metric_value. Each type
keeps its own rule for users without events: mean-like metrics drop them, counts and
proportions give 0, a filtered mean gives null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemetric.operators.exposure import UNIT, exposed_events, of_type, within_window

AGGREGATES = ("mean", "sum", "count", "count_distinct", "proportion", "percentile")


def checked_fraction(p: float) -> float:
    if not 0 < p < 1:
        raise ValueError("a percentile lies between 0 and 1")
    return p


def mean(events: DataFrame, users: DataFrame, event_type: str) -> DataFrame:
    return exposed_events(of_type(events, event_type), users).groupBy(*UNIT).agg(F.avg("value").alias("metric_value"))


def proportion(events: DataFrame, users: DataFrame, event_type: str) -> DataFrame:
    """1 for users with an event of the type, else 0."""
    rows = exposed_events(of_type(events, event_type), users, "left")
    return rows.groupBy(*UNIT).agg(F.when(F.count("event_id") > 0, 1.0).otherwise(0.0).alias("metric_value"))


def count(events: DataFrame, users: DataFrame, event_type: str) -> DataFrame:
    """Events with a non-null value; 0 without events."""
    return exposed_events(of_type(events, event_type), users, "left").groupBy(*UNIT).agg(F.count("value").cast("double").alias("metric_value"))


def _both_sums(events: DataFrame, users: DataFrame, numerator: str, denominator: str) -> DataFrame:
    both = events.filter(F.col("event_type").isin(numerator, denominator))
    pick = lambda t: F.coalesce(F.sum(F.when(F.col("event_type") == t, F.col("value"))), F.lit(0.0))
    return exposed_events(both, users, "left").groupBy(*UNIT).agg(pick(numerator).alias("numerator"), pick(denominator).alias("denominator"))


def ratio(events: DataFrame, users: DataFrame, numerator: str, denominator: str) -> DataFrame:
    """Sum of one type over the sum of another, in one pass; 0 where the denominator is 0.

    Each side is summed on its own. A join of both sides before the sum would multiply
    each by the other's row count, which is not the ratio of two sums.
    """
    sums = _both_sums(events, users, numerator, denominator)
    return sums.select(*UNIT, F.coalesce(F.try_divide("numerator", "denominator"), F.lit(0.0)).alias("metric_value"))


def ratio_moments(events: DataFrame, users: DataFrame, numerator: str, denominator: str) -> DataFrame:
    """Per variant: users, means, variances and covariance of both sides, for the delta method."""
    x, y = "numerator", "denominator"
    return _both_sums(events, users, numerator, denominator).groupBy("variant_id").agg(
        F.count("*").alias("users"), F.avg(x).alias("mean_numerator"), F.avg(y).alias("mean_denominator"),
        F.var_samp(x).alias("var_numerator"), F.var_samp(y).alias("var_denominator"), F.covar_samp(x, y).alias("covariance"),
    )


def percentile(events: DataFrame, users: DataFrame, event_type: str, p: float, exact: bool = True) -> DataFrame:
    """Percentile of values, p in (0, 1): interpolated, or an element of the data when approximate."""
    pick = F.percentile("value", checked_fraction(p)) if exact else F.percentile_approx("value", checked_fraction(p))
    return exposed_events(of_type(events, event_type), users).groupBy(*UNIT).agg(pick.alias("metric_value"))


def filtered_mean(events: DataFrame, users: DataFrame, event_type: str, value_column: str, where: Column) -> DataFrame:
    """Mean of a column over events that satisfy ``where``; null for users without one."""
    return exposed_events(of_type(events, event_type, where), users, "left").groupBy(*UNIT).agg(F.avg(value_column).alias("metric_value"))


def windowed_count(events: DataFrame, users: DataFrame, event_type: str, hours: int, where: Column | None = None) -> DataFrame:
    """Events within ``hours`` of the user's first exposure; 0 without."""
    return within_window(of_type(events, event_type, where), users, hours).groupBy(*UNIT).agg(F.count("event_id").cast("double").alias("metric_value"))


def session_mean(events: DataFrame, session_users: DataFrame, event_type: str) -> DataFrame:
    """Mean per user, variant and session; ``session_users`` has the session key too."""
    rows = of_type(events, event_type).join(session_users, ["user_id", "session_no"])
    return rows.groupBy(*UNIT, "session_no").agg(F.avg("value").alias("metric_value"))


def lifecycle_mean(events: DataFrame, segment_users: DataFrame, event_type: str) -> DataFrame:
    """Mean per user, variant and lifecycle segment."""
    return exposed_events(of_type(events, event_type), segment_users).groupBy(*UNIT, "lifecycle_segment").agg(F.avg("value").alias("metric_value"))


def cuped_covariate(events: DataFrame, users: DataFrame, event_type: str, start: str, days: int = 7) -> DataFrame:
    """Mean of the covariate event in [start - days, start), 0 without; the date bound reaches the scan."""
    begin = F.to_date(F.lit(start))
    before = of_type(events, event_type).filter((F.col("event_date") >= F.date_sub(begin, days)) & (F.col("event_date") < begin))
    return exposed_events(before, users, "left").groupBy(*UNIT).agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("cuped_covariate"))


def guardrail_value(events: DataFrame, users: DataFrame, event_type: str) -> DataFrame:
    """(variant_id, current_value): mean over all events of the variant's users."""
    return exposed_events(of_type(events, event_type), users).groupBy("variant_id").agg(F.avg("value").alias("current_value"))


def qoe_metric(qoe: DataFrame, users: DataFrame, field: str) -> DataFrame:
    return exposed_events(qoe, users).groupBy(*UNIT).agg(F.avg(F.col(field).cast("double")).alias("metric_value"))


def ebvs_rate(qoe: DataFrame, users: DataFrame) -> DataFrame:
    """Share of sessions that ended before video start."""
    return qoe_metric(qoe.withColumn("ebvs", F.col("ebvs_detected").cast("double")), users, "ebvs")


def qoe_engagement_correlation(qoe: DataFrame, events: DataFrame, users: DataFrame, field: str, event_type: str) -> DataFrame:
    """Per variant: correlation, users, means and deviations of a QoE field and an engagement metric."""
    x = qoe_metric(qoe, users, field).withColumnRenamed("metric_value", "x")
    y = mean(events, users, event_type).withColumnRenamed("metric_value", "y")
    return x.join(y, UNIT).groupBy("variant_id").agg(
        F.corr("x", "y").alias("correlation"), F.count("*").alias("users"), F.avg("x").alias("mean_qoe"), F.avg("y").alias("mean_engagement"),
        F.stddev_samp("x").alias("sd_qoe"), F.stddev_samp("y").alias("sd_engagement"),
    )


def content_consumption(events: DataFrame, users: DataFrame, event_type: str | None = None) -> DataFrame:
    """Per variant and content: watch time, views, unique viewers; of all event types unless one is named."""
    rows = exposed_events(of_type(events, event_type).filter(F.col("content_id").isNotNull()), users)
    return rows.groupBy("variant_id", "content_id").agg(F.sum("value").alias("watch_time_seconds"), F.count("*").alias("view_count"), F.count_distinct("user_id").alias("unique_viewers"))


def daily_treatment_effect(summaries: DataFrame, control: str = "control", per_variant: bool = False) -> DataFrame:
    """Per day: treatment and control mean, their difference and the rows behind it.

    Pools all treatment variants, or has a row for each with ``per_variant``.
    """
    is_control = F.col("variant_id") == control
    if not per_variant:
        sums = summaries.groupBy("computation_date").agg(
            F.avg(F.when(~is_control, F.col("metric_value"))).alias("treatment_mean"), F.avg(F.when(is_control, F.col("metric_value"))).alias("control_mean"), F.count("*").alias("sample_size")
        )
        return sums.withColumn("absolute_effect", F.col("treatment_mean") - F.col("control_mean"))
    means = summaries.groupBy("computation_date", "variant_id").agg(F.avg("metric_value").alias("treatment_mean"), F.count("*").alias("rows"))
    base = means.filter(is_control).select("computation_date", F.col("treatment_mean").alias("control_mean"), F.col("rows").alias("control_rows"))
    return means.filter(~is_control).join(base, "computation_date").select(
        "computation_date", "variant_id", "treatment_mean", "control_mean", (F.col("rows") + F.col("control_rows")).alias("sample_size"), (F.col("treatment_mean") - F.col("control_mean")).alias("absolute_effect")
    )


def surrogate_input(summaries: DataFrame, metrics: list[str], as_of: str, days: int) -> DataFrame:
    """Variant × metric mean and users over the last ``days`` days up to ``as_of``."""
    end = F.to_date(F.lit(as_of))
    rows = summaries.filter(F.col("metric_id").isin(*metrics) & (F.col("computation_date") >= F.date_sub(end, days)) & (F.col("computation_date") <= end))
    return rows.groupBy("variant_id", "metric_id").agg(F.avg("metric_value").alias("avg_value"), F.count_distinct("user_id").alias("users"))


def feedback_loop_contamination(summaries: DataFrame, retrainings: DataFrame, control: str = "control", days: int = 7) -> DataFrame:
    """Per retraining: effect in the ``days`` days before and after it.

    Retrainings are a short list of events, joined by date range against summaries that
    are first reduced to one row per day and arm.
    """
    is_control = (F.col("variant_id") == control).alias("is_control")
    daily = summaries.groupBy(is_control, "computation_date").agg(F.sum("metric_value").alias("total"), F.count("metric_value").alias("rows"))
    near = daily.join(retrainings, (F.col("computation_date") >= F.date_sub("retrained_on", days)) & (F.col("computation_date") < F.date_add("retrained_on", days)))
    before = F.col("computation_date") < F.col("retrained_on")
    pick = lambda when: F.try_divide(F.sum(F.when(when, F.col("total"))), F.sum(F.when(when, F.col("rows"))))
    out = near.groupBy("retraining_event_id", "treatment_contamination_fraction").agg(
        (pick(before & ~F.col("is_control")) - pick(before & F.col("is_control"))).alias("pre_effect"),
        (pick(~before & ~F.col("is_control")) - pick(~before & F.col("is_control"))).alias("post_effect"),
    )
    return out.filter("pre_effect is not null and post_effect is not null")


def interleaving_scores(events: DataFrame, users: DataFrame, provenance: Column, event_type: str, credit: str = "binary") -> DataFrame:
    """Per user: credit of each algorithm as a map, the winner, and engagements.

    ``provenance`` maps an event to the algorithm that ranked its content. Credit: binary
    (1 to whoever has most clicks), weighted (values), proportional (share of clicks). The
    winner is the one algorithm at the top; a tie has none.
    """
    rows = exposed_events(of_type(events, event_type), users).withColumn("algorithm", provenance).filter("algorithm is not null")
    clicks = rows.groupBy("user_id", "algorithm").agg(F.count("*").alias("clicks"), F.sum("value").alias("total"))
    own = Window.partitionBy("user_id")
    top = F.max("clicks").over(own)
    score = {
        "binary": F.when(F.col("clicks") == top, 1.0).otherwise(0.0),
        "weighted": F.col("total"),
        "proportional": F.col("clicks") / F.sum("clicks").over(own),
    }[credit]
    scored = clicks.withColumn("score", score)
    best = scored.withColumn("best", F.max("score").over(own))
    first = F.when(F.col("score") == F.col("best"), F.col("algorithm"))
    return best.groupBy("user_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("algorithm", "score")))).alias("algorithm_scores"),
        F.when(F.count(first) == 1, F.max(first)).alias("winning_algorithm_id"),
        F.sum("clicks").alias("total_engagements"),
    )


def expr_aggregate(events: DataFrame, users: DataFrame, fn: str, event_type: str, field: str | None = None, where: Column | None = None, within_hours: int | None = None, p: float | None = None) -> DataFrame:
    """One function for all expression aggregates, with an optional window after first exposure.

    ``count`` counts rows (the typed count metric counts values) and, like ``proportion``,
    takes no field; the others need one. Users without events: 0 for count, proportion
    and count_distinct, else none.
    """
    if fn not in AGGREGATES:
        raise ValueError(f"no such aggregate: {fn!r}")
    if (fn in ("count", "proportion")) != (field is None):
        raise ValueError(f"{fn} {'takes no' if field else 'needs a'} field")
    if (fn == "percentile") != (p is not None):
        raise ValueError("percentile, and only it, takes p")
    rows = of_type(events, event_type, where)
    joined = within_window(rows, users, within_hours) if within_hours is not None else exposed_events(rows, users, "left")
    found = F.count("event_id")
    value = {
        "count": lambda: found.cast("double"),
        "proportion": lambda: F.when(found > 0, 1.0).otherwise(0.0),
        "mean": lambda: F.avg(field),
        "sum": lambda: F.sum(field),
        "count_distinct": lambda: F.count_distinct(field).cast("double"),
        "percentile": lambda: F.percentile(field, checked_fraction(p)),
    }[fn]()
    out = joined.groupBy(*UNIT).agg(value.alias("metric_value"), found.alias("found"))
    return (out if fn in ("count", "proportion", "count_distinct") else out.filter("found > 0")).drop("found")


def metric_columns(values: DataFrame, metrics: list[str]) -> DataFrame:
    """Long metric rows (metric_id, metric_value) to one row per user with a column per metric."""
    return values.groupBy(*UNIT).pivot("metric_id", metrics).agg(F.max("metric_value"))


def composite(values: DataFrame, operator: str, operands: list[str], weights: list[float] | None = None) -> DataFrame:
    """ADD, SUBTRACT, MULTIPLY, DIVIDE (null by zero) or WEIGHTED_SUM of computed metrics."""
    if len(operands) < 2 or (operator == "WEIGHTED_SUM") != (weights is not None) or (weights and len(weights) != len(operands)):
        raise ValueError("a composite needs two operands or more, and WEIGHTED_SUM a weight for each")
    columns = [F.col(f"`{m}`") for m in operands]
    value = {
        "ADD": lambda: reduce(lambda a, b: a + b, columns),
        "SUBTRACT": lambda: reduce(lambda a, b: a - b, columns),
        "MULTIPLY": lambda: reduce(lambda a, b: a * b, columns),
        "DIVIDE": lambda: reduce(lambda a, b: F.try_divide(a, b), columns),
        "WEIGHTED_SUM": lambda: reduce(lambda a, b: a + b, [F.lit(float(w)) * c for w, c in zip(weights, columns, strict=True)]),
    }[operator]()
    return metric_columns(values, operands).select(*UNIT, value.alias("metric_value"))


def ref(metric: str) -> Column:
    """A computed metric inside ``expr_arithmetic``."""
    return F.col(f"`{metric}`")


def ratio_of(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def expr_arithmetic(values: DataFrame, metrics: list[str], expression: Column) -> DataFrame:
    """A column expression over ``ref(metric)``: arithmetic, unary minus, literals, nested ``ratio_of``."""
    if not metrics:
        raise ValueError("an expression refers to a metric at least")
    return metric_columns(values, metrics).select(*UNIT, expression.alias("metric_value"))


def expr_ratio(values: DataFrame, numerator: str, denominator: str) -> DataFrame:
    return expr_arithmetic(values, [numerator, denominator], ratio_of(ref(numerator), ref(denominator)))


def compute_metrics(events: DataFrame, users: DataFrame, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """Many metrics in one scan: {metric_id: (fn, event_type)} with fn in mean, sum, count, proportion.

    All metrics are conditional aggregates of one ``groupBy`` over one join, so the events
    are read and shuffled once however many metrics there are. Returns long rows; mean and
    sum have none for users without an event of the type.
    """
    kinds = sorted({t for _, t in metrics.values()})
    rows = exposed_events(events.filter(F.col("event_type").isin(*kinds)), users, "left")
    parts = []
    for name, (fn, kind) in metrics.items():
        own = F.col("event_type") == kind
        parts.append({
            "mean": F.avg(F.when(own, F.col("value"))),
            "sum": F.sum(F.when(own, F.col("value"))),
            "count": F.count(F.when(own, F.col("value"))).cast("double"),
            "proportion": F.max(F.when(own, 1.0).otherwise(0.0)),
        }[fn].alias(name))
    wide = rows.groupBy(*UNIT).agg(*parts)
    entries = F.array(*[F.struct(F.lit(n).alias("metric_id"), F.col(f"`{n}`").alias("metric_value")) for n in metrics])
    return wide.select(*UNIT, F.inline(entries)).filter("metric_value is not null")


def mlrate_features(events: DataFrame, users: DataFrame, event_types: list[str], start: str, days: int, folds: int, fold: Column | None = None) -> DataFrame:
    """Pre-period mean per event type as columns, and a fold by a hash of the user (or ``fold``)."""
    begin = F.to_date(F.lit(start))
    before = events.filter(F.col("event_type").isin(*event_types) & (F.col("event_date") >= F.date_sub(begin, days)) & (F.col("event_date") < begin))
    wide = before.groupBy("user_id").pivot("event_type", event_types).agg(F.avg("value")).fillna(0.0, event_types)
    number = F.pmod(F.xxhash64("user_id"), F.lit(folds)) + 1 if fold is None else fold
    return users.select(*UNIT).join(wide, "user_id", "left").fillna(0.0, event_types).withColumn("fold", number.cast("int"))


def crossfit_predict(features: DataFrame, outcome: str, feature: str) -> DataFrame:
    """Off-fold least-squares prediction of ``outcome`` from ``feature``.

    Moment sums per fold are subtracted from their total, so each fold is scored by a line
    fitted on all others, in two small aggregations and a join on the fold.
    """
    x, y = F.col(feature), F.col(outcome)
    sums = features.groupBy("fold").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"))
    every = Window.partitionBy()
    rest = sums.select("fold", *[(F.sum(c).over(every) - F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx")])
    slope = F.coalesce(F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")), F.lit(0.0))
    fit = rest.withColumn("slope", slope).withColumn("intercept", F.try_divide(F.col("sy") - F.col("slope") * F.col("sx"), F.col("n"))).select("fold", "slope", "intercept")
    return features.join(fit, "fold").withColumn("predicted", F.col("intercept") + F.col("slope") * x).drop("slope", "intercept")
