"""Metric, join, catalog and window queries over the experiment views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemetric.functions.predicates import all_of, filter_text, targeting
from tidemetric.operators import catalog as C
from tidemetric.operators import metrics as M
from tidemetric.operators.exposure import exposed_events, exposed_users, of_type, within_window
from tidemetric.operators.inference import earlier_sums
from tidemetric.operators.sessions import playback_metrics
from tidemetric.plans.registry import query, rounded
from tidemetric.sources import views as V


def _events(spark, sf):
    return V.metric_events(spark, sf)


def _users(spark, sf, *more):
    return exposed_users(V.exposures(spark, sf), *more, experiment="exp")


@query("SELECT user_id, variant_id, round(min(assignment_probability), 6) AS assignment_probability, count(*) AS exposures FROM exposures GROUP BY 1, 2")
def p1_exposed_users(spark: SparkSession, sf: str) -> DataFrame:
    counted = V.exposures(spark, sf).groupBy("user_id", "variant_id").agg(F.count("*").alias("exposures"))
    return rounded(_users(spark, sf).drop("first_exposure").join(counted, ["user_id", "variant_id"]))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM metric_events WHERE content_id IS NOT NULL AND event_type = 'view' GROUP BY 1")
def p2_event_filter(spark, sf):
    return rounded(of_type(_events(spark, sf), "view", F.col("content_id").isNotNull()).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


@query("SELECT event_type, count(*) AS n FROM metric_events WHERE value > 20 AND NOT content_id = 5 OR event_type IN ('error') AND value IS NOT NULL GROUP BY 1")
def p3_filter_text(spark, sf):
    where = filter_text("value > 20 AND NOT content_id = 5 OR event_type IN ('error') AND value IS NOT NULL")
    return _events(spark, sf).filter(where).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n FROM metric_events WHERE content_id IN (1, 2, 3) AND value >= 5 AND event_type != 'error' GROUP BY 1")
def p4_rule_list(spark, sf):
    where = all_of([("content_id", "IN", [1, 2, 3]), ("value", ">=", 5), ("event_type", "!=", "error")])
    return _events(spark, sf).filter(where).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT e.user_id, eu.variant_id, round(max(e.value), 6) AS metric_value FROM metric_events e JOIN eu USING (user_id) GROUP BY 1, 2")
def p5_custom_sql(spark, sf):
    from tidemetric.operators.custom import custom_metric

    return rounded(custom_metric(spark, "SELECT user_id, max(value) AS metric_value FROM metric_events GROUP BY user_id", {"metric_events": _events(spark, sf)}, _users(spark, sf)).drop("assignment_probability", "first_exposure"))


@query("""SELECT user_id, (user_id % 4) IN (0, 1) AND ((user_id % 7) > 2 OR user_id % 5 = 0) AS eligible FROM (SELECT DISTINCT user_id FROM metric_events)""")
def p6_targeting(spark, sf):
    users = _events(spark, sf).select("user_id").distinct()
    attributes = F.create_map(F.lit("platform"), (F.col("user_id") % 4).cast("string"), F.lit("age"), (F.col("user_id") % 7).cast("string"), F.lit("plan"), (F.col("user_id") % 5).cast("string"))
    rule = targeting(attributes, [[("platform", "IN", ["0", "1"])], [("age", "GT", ["2"]), ("plan", "EQUALS", ["0"]), ("absent", "LT", ["1"])]])
    return users.select("user_id", rule.alias("eligible"))


@query("SELECT user_id, round(avg(time_to_first_frame_ms), 6) AS ttff, round(avg(rebuffer_ratio), 6) AS rebuffer, round(avg(avg_bitrate_kbps), 6) AS bitrate FROM qoe_events GROUP BY 1")
def p8_field_choice(spark, sf):
    fields = {"ttff": "time_to_first_frame_ms", "rebuffer": "rebuffer_ratio", "bitrate": "avg_bitrate_kbps"}
    return rounded(V.qoe_events(spark, sf).groupBy("user_id").agg(*[F.avg(F.col(f)).alias(a) for a, f in fields.items()]))


@query("SELECT variant_id, count(*) AS events, round(sum(value), 4) AS total FROM metric_events JOIN eu USING (user_id) WHERE event_type = 'purchase' GROUP BY 1")
def j1_inner_join(spark, sf):
    return rounded(exposed_events(of_type(_events(spark, sf), "purchase"), _users(spark, sf)).groupBy("variant_id").agg(F.count("*").alias("events"), F.sum("value").alias("total")), 4)


@query("""SELECT s.user_id, s.session_no, count(*) AS events FROM sessions s JOIN (SELECT DISTINCT user_id, session_no FROM sessions WHERE event_timestamp >= TIMESTAMP '2024-01-08') x USING (user_id, session_no) GROUP BY 1, 2""")
def j2_two_key_join(spark, sf):
    s = V.sessions(spark, sf)
    exposed = s.filter(F.col("event_date") >= F.lit(V.START).cast("date")).select("user_id", "session_no").distinct()
    return s.join(exposed, ["user_id", "session_no"]).groupBy("user_id", "session_no").agg(F.count("*").alias("events"))


@query("SELECT eu.user_id, variant_id, count(e.event_id) AS events FROM eu LEFT JOIN (SELECT * FROM metric_events WHERE event_type = 'signup' AND value > 100) e USING (user_id) GROUP BY 1, 2")
def j3_left_join(spark, sf):
    rows = exposed_events(of_type(_events(spark, sf), "signup", F.col("value") > 100), _users(spark, sf), "left")
    return rows.groupBy("user_id", "variant_id").agg(F.count("event_id").alias("events"))


@query("""SELECT eu.user_id, count(e.event_id) AS events, round(coalesce(sum(value), 0), 4) AS total FROM eu LEFT JOIN metric_events e
  ON e.user_id = eu.user_id AND e.event_timestamp >= first_exposure AND e.event_timestamp < first_exposure + INTERVAL 72 HOUR GROUP BY 1""")
def j4_window_join(spark, sf):
    rows = within_window(_events(spark, sf), _users(spark, sf), 72)
    return rounded(rows.groupBy("user_id").agg(F.count("event_id").alias("events"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total")), 4)


@query("SELECT retraining_event_id, count(*) AS rows_near FROM retrainings JOIN summaries ON computation_date BETWEEN retrained_on - 7 AND retrained_on + 6 GROUP BY 1")
def j5_range_join(spark, sf):
    daily = V.metric_summaries(spark, sf).groupBy("computation_date").agg(F.count("*").alias("rows"))
    near = daily.join(F.broadcast(V.model_retraining_events(spark)), F.col("computation_date").between(F.date_sub("retrained_on", 7), F.date_add("retrained_on", 6)))
    return near.groupBy("retraining_event_id").agg(F.sum("rows").alias("rows_near"))


_IMPRESSIONS = "imp AS (SELECT variant_id, content_id, count(*) AS n FROM metric_events JOIN eu USING (user_id) WHERE content_id IS NOT NULL GROUP BY 1, 2)"
_PROVIDERS = _IMPRESSIONS + ", prov AS (SELECT variant_id, provider_id, sum(n)::bigint AS n FROM imp JOIN content_catalog USING (content_id) GROUP BY 1, 2)"


def _imp(spark, sf):
    return C.impressions(_events(spark, sf), _users(spark, sf))


def _prov(spark, sf):
    return C.provider_impressions(_events(spark, sf), _users(spark, sf), V.content_catalog(spark, sf))


@query(f"WITH {_IMPRESSIONS} SELECT variant_id, content_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT content_id FROM content_catalog) CROSS JOIN (SELECT DISTINCT variant_id FROM imp) LEFT JOIN imp USING (variant_id, content_id)")
def j6_zero_fill(spark, sf):
    return C.zero_filled(_imp(spark, sf), V.content_catalog(spark, sf), "content_id")


@query(f"WITH {_IMPRESSIONS} SELECT variant_id, round(count(DISTINCT content_id)::double / (SELECT count(DISTINCT content_id) FROM content_catalog), 6) AS metric_value FROM imp WHERE content_id IN (SELECT content_id FROM content_catalog) GROUP BY 1")
def v1_catalog_coverage(spark, sf):
    return rounded(C.coverage_rate(_imp(spark, sf), V.content_catalog(spark, sf)))


_GINI = "SELECT variant_id, round(2.0 * sum(rank * n) / (count(*) * sum(n)) - (count(*) + 1.0) / count(*), 6) AS metric_value FROM (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY n, {key}) AS rank FROM filled) GROUP BY 1"


@query(f"WITH {_IMPRESSIONS}, filled AS (SELECT variant_id, content_id, coalesce(n, 0) AS n FROM content_catalog CROSS JOIN (SELECT DISTINCT variant_id FROM imp) LEFT JOIN imp USING (variant_id, content_id)) " + _GINI.format(key="content_id"))
def v2_catalog_gini(spark, sf):
    return rounded(C.catalog_gini(_imp(spark, sf), V.content_catalog(spark, sf)))


@query(f"WITH {_IMPRESSIONS} SELECT variant_id, round(-sum(p * ln(p)), 6) AS metric_value FROM (SELECT variant_id, n / sum(n) OVER (PARTITION BY variant_id) AS p FROM imp) GROUP BY 1")
def v3_catalog_entropy(spark, sf):
    return rounded(C.entropy(_imp(spark, sf), ["variant_id"]))


@query(f"WITH {_IMPRESSIONS} SELECT variant_id, round(sum(CASE WHEN r >= 0.8 THEN n ELSE 0 END)::double / sum(n), 6) AS metric_value FROM imp JOIN (SELECT content_id, percent_rank() OVER (ORDER BY sum(n) DESC) AS r FROM imp GROUP BY 1) USING (content_id) GROUP BY 1")
def v4_longtail_share(spark, sf):
    return rounded(C.longtail_share(_imp(spark, sf)))


@query(f"WITH {_PROVIDERS}, filled AS (SELECT variant_id, provider_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT provider_id FROM content_catalog) CROSS JOIN (SELECT DISTINCT variant_id FROM prov) LEFT JOIN prov USING (variant_id, provider_id)) " + _GINI.format(key="provider_id"))
def v5_provider_gini(spark, sf):
    return rounded(C.provider_gini(_prov(spark, sf), V.content_catalog(spark, sf)))


@query(f"WITH {_PROVIDERS} SELECT variant_id, round(min(n)::double / max(n), 6) AS metric_value FROM prov GROUP BY 1")
def v6_provider_parity(spark, sf):
    return rounded(C.provider_parity(_prov(spark, sf)))


_GENRES = "gen AS (SELECT user_id, variant_id, genre, count(*) AS n FROM metric_events JOIN eu USING (user_id) JOIN content_catalog USING (content_id) GROUP BY 1, 2, 3), shares AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id, variant_id) AS p FROM gen)"


@query(f"WITH {_GENRES} SELECT user_id, variant_id, round(-sum(p * ln(p)), 6) AS metric_value FROM shares GROUP BY 1, 2")
def v7_user_genre_entropy(spark, sf):
    return rounded(C.user_genre_entropy(_events(spark, sf), _users(spark, sf), V.content_catalog(spark, sf)))


@query("""SELECT user_id, variant_id, round(avg((first >= DATE '2024-01-08')::int), 6) AS metric_value FROM
  (SELECT user_id, content_id, min(event_date) AS first, max(event_date) AS last FROM metric_events WHERE content_id IS NOT NULL GROUP BY 1, 2) JOIN eu USING (user_id) WHERE last >= DATE '2024-01-08' GROUP BY 1, 2""")
def v8_user_discovery_rate(spark, sf):
    return rounded(C.user_discovery_rate(_events(spark, sf), _users(spark, sf), V.START))


@query("SELECT user_id, variant_id, count(DISTINCT provider_id)::double AS metric_value FROM metric_events JOIN eu USING (user_id) JOIN content_catalog USING (content_id) GROUP BY 1, 2")
def v9_user_provider_diversity(spark, sf):
    return C.user_provider_diversity(_events(spark, sf), _users(spark, sf), V.content_catalog(spark, sf))


@query(f"WITH {_GENRES} SELECT user_id, variant_id, round(1 - sum(p * p), 6) AS metric_value FROM shares GROUP BY 1, 2")
def v10_intra_list_distance(spark, sf):
    return rounded(C.intra_list_distance(_events(spark, sf), _users(spark, sf), V.content_catalog(spark, sf)))


@query("SELECT user_id, count(DISTINCT content_id) AS new_contents FROM metric_events a WHERE event_date >= DATE '2024-01-08' AND NOT EXISTS (SELECT 1 FROM metric_events b WHERE b.user_id = a.user_id AND b.content_id = a.content_id AND b.event_date < DATE '2024-01-08') GROUP BY 1")
def j9_anti_join(spark, sf):
    e = _events(spark, sf)
    begin = F.lit(V.START).cast("date")
    old = e.filter(F.col("event_date") < begin).select("user_id", "content_id")
    return e.filter(F.col("event_date") >= begin).join(old, ["user_id", "content_id"], "left_anti").groupBy("user_id").agg(F.count_distinct("content_id").alias("new_contents"))


# --- metrics -----------------------------------------------------------------------

_MEAN = "SELECT user_id, variant_id, round(avg(value), 6) AS metric_value FROM metric_events JOIN eu USING (user_id) WHERE event_type = 'view' GROUP BY 1, 2"


@query(_MEAN)
def m1_mean(spark, sf):
    return rounded(M.mean(_events(spark, sf), _users(spark, sf), "view"))


@query("SELECT eu.user_id, variant_id, CASE WHEN count(e.event_id) > 0 THEN 1.0::double ELSE 0.0 END AS metric_value FROM eu LEFT JOIN (SELECT * FROM metric_events WHERE event_type = 'purchase') e USING (user_id) GROUP BY 1, 2")
def m2_proportion(spark, sf):
    return M.proportion(_events(spark, sf), _users(spark, sf), "purchase")


@query("SELECT eu.user_id, variant_id, count(e.value)::double AS metric_value FROM eu LEFT JOIN (SELECT * FROM metric_events WHERE event_type = 'click') e USING (user_id) GROUP BY 1, 2")
def m3_count(spark, sf):
    return M.count(_events(spark, sf), _users(spark, sf), "click")


_SUMS = "sums AS (SELECT eu.user_id, variant_id, coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS a, coalesce(sum(value) FILTER (event_type = 'click'), 0) AS b FROM eu LEFT JOIN metric_events e USING (user_id) GROUP BY 1, 2)"


@query(f"WITH {_SUMS} SELECT user_id, variant_id, round(CASE WHEN b = 0 THEN 0 ELSE a / b END, 6) AS metric_value FROM sums")
def m4_ratio(spark, sf):
    return rounded(M.ratio(_events(spark, sf), _users(spark, sf), "purchase", "click"))


@query(f"""WITH {_SUMS} SELECT variant_id, count(*) AS users, round(avg(a), 6) AS mean_numerator, round(avg(b), 6) AS mean_denominator, round(var_samp(a), 6) AS var_numerator,
  round(var_samp(b), 6) AS var_denominator, round(covar_samp(a, b), 6) AS covariance FROM sums GROUP BY 1""")
def m5_ratio_delta_method(spark, sf):
    return rounded(M.ratio_moments(_events(spark, sf), _users(spark, sf), "purchase", "click"))


@query("SELECT user_id, variant_id, round(quantile_cont(value, 0.9), 6) AS metric_value FROM metric_events JOIN eu USING (user_id) WHERE event_type = 'view' GROUP BY 1, 2")
def m6_percentile(spark, sf):
    return rounded(M.percentile(_events(spark, sf), _users(spark, sf), "view", 0.9))


@query("SELECT eu.user_id, variant_id, round(avg(e.value), 6) AS metric_value FROM eu LEFT JOIN (SELECT * FROM metric_events WHERE event_type = 'view' AND content_id < 5) e USING (user_id) GROUP BY 1, 2")
def m7_filtered_mean(spark, sf):
    return rounded(M.filtered_mean(_events(spark, sf), _users(spark, sf), "view", "value", F.col("content_id") < 5))


@query("""SELECT eu.user_id, variant_id, count(e.event_id)::double AS metric_value FROM eu LEFT JOIN (SELECT * FROM metric_events WHERE event_type = 'click') e
  ON e.user_id = eu.user_id AND e.event_timestamp >= first_exposure AND e.event_timestamp < first_exposure + INTERVAL 48 HOUR GROUP BY 1, 2""")
def m8_windowed_count(spark, sf):
    return M.windowed_count(_events(spark, sf), _users(spark, sf), "click", 48)


_VALUES = """vals AS (SELECT eu.user_id, variant_id, avg(value) FILTER (event_type = 'view') AS v, count(value) FILTER (event_type = 'click')::double AS c FROM eu LEFT JOIN metric_events USING (user_id) GROUP BY 1, 2)"""


def _values(spark, sf):
    return M.compute_metrics(_events(spark, sf), _users(spark, sf), {"v": ("mean", "view"), "c": ("count", "click")})


@query(f"WITH {_VALUES} SELECT user_id, variant_id, round(0.3 * v + 0.7 * c, 6) AS metric_value FROM vals")
def m9_composite(spark, sf):
    return rounded(M.composite(_values(spark, sf), "WEIGHTED_SUM", ["v", "c"], [0.3, 0.7]))


@query("""SELECT user_id, variant_id, count(DISTINCT content_id)::double AS metric_value FROM eu LEFT JOIN (SELECT user_id AS u, event_timestamp AS t, content_id FROM metric_events WHERE event_type = 'view' AND value > 3) e
  ON u = user_id AND t >= first_exposure AND t < first_exposure + INTERVAL 168 HOUR GROUP BY 1, 2""")
def m10_expr_aggregate(spark, sf):
    return M.expr_aggregate(_events(spark, sf), _users(spark, sf), "count_distinct", "view", "content_id", F.col("value") > 3, within_hours=7 * 24)


@query(f"WITH {_VALUES} SELECT user_id, variant_id, round(CASE WHEN c = 0 THEN 0 ELSE v / c END, 6) AS metric_value FROM vals")
def m11_expr_ratio(spark, sf):
    return rounded(M.expr_ratio(_values(spark, sf), "v", "c"))


@query(f"WITH {_VALUES} SELECT user_id, variant_id, round(-(v + 2.5) * c + CASE WHEN c = 0 THEN 0 ELSE v / c END - 1, 6) AS metric_value FROM vals")
def m12_expr_arithmetic(spark, sf):
    return rounded(M.expr_arithmetic(_values(spark, sf), ["v", "c"], -(M.ref("v") + 2.5) * M.ref("c") + M.ratio_of(M.ref("v"), M.ref("c")) - 1))


@query(f"WITH {_VALUES} SELECT user_id, variant_id, metric_id, round(metric_value, 6) AS metric_value FROM (SELECT user_id, variant_id, 'v' AS metric_id, v AS metric_value FROM vals UNION ALL SELECT user_id, variant_id, 'c', c FROM vals) WHERE metric_value IS NOT NULL")
def m0_shared_scan(spark, sf):
    return rounded(_values(spark, sf))


@query(f"WITH {_VALUES} SELECT user_id, variant_id, metric_id, round(metric_value, 6) AS metric_value FROM (SELECT user_id, variant_id, 'v' AS metric_id, v AS metric_value FROM vals UNION ALL SELECT user_id, variant_id, 'c', c FROM vals UNION ALL SELECT user_id, variant_id, 'total', v + c FROM vals) WHERE metric_value IS NOT NULL")
def m14_ordered_run(spark, sf):
    from tidemetric.plans.runner import Step, run_metrics

    e, u = _events(spark, sf), _users(spark, sf)
    steps = [
        Step("total", ("v", "c"), lambda done: M.composite(done, "ADD", ["v", "c"]).filter("metric_value is not null")),
        Step("v", (), lambda done: M.mean(e, u, "view")),
        Step("c", (), lambda done: M.count(e, u, "click")),
    ]
    return rounded(run_metrics(steps).values)


@query("SELECT user_id, variant_id, session_no, round(avg(value), 6) AS metric_value FROM sessions JOIN eu USING (user_id) WHERE event_type = 'view' AND (user_id, session_no) IN (SELECT (user_id, session_no) FROM sessions WHERE event_date >= DATE '2024-01-08') GROUP BY 1, 2, 3")
def m15_session_mean(spark, sf):
    s = V.sessions(spark, sf)
    own = s.filter(F.col("event_date") >= F.lit(V.START).cast("date")).select("user_id", "session_no").distinct().join(_users(spark, sf).select("user_id", "variant_id"), "user_id")
    return rounded(M.session_mean(s, own, "view"))


@query("SELECT user_id, variant_id, lifecycle_segment, round(avg(value), 6) AS metric_value FROM metric_events JOIN (SELECT DISTINCT user_id, variant_id, lifecycle_segment FROM exposures) USING (user_id) WHERE event_type = 'view' GROUP BY 1, 2, 3")
def m16_lifecycle_mean(spark, sf):
    return rounded(M.lifecycle_mean(_events(spark, sf), _users(spark, sf, "lifecycle_segment"), "view"))


@query("SELECT eu.user_id, variant_id, round(coalesce(avg(value), 0), 6) AS cuped_covariate FROM eu LEFT JOIN (SELECT * FROM metric_events WHERE event_type = 'view' AND event_date >= DATE '2024-01-01' AND event_date < DATE '2024-01-08') USING (user_id) GROUP BY 1, 2")
def m17_cuped_covariate(spark, sf):
    return rounded(M.cuped_covariate(_events(spark, sf), _users(spark, sf), "view", V.START, 7))


@query("SELECT variant_id, round(avg(value), 6) AS current_value FROM metric_events JOIN eu USING (user_id) WHERE event_type = 'error' GROUP BY 1")
def m18_guardrail_value(spark, sf):
    return rounded(M.guardrail_value(_events(spark, sf), _users(spark, sf), "error"))


@query("SELECT user_id, variant_id, round(avg(time_to_first_frame_ms), 6) AS metric_value FROM qoe_events JOIN eu USING (user_id) GROUP BY 1, 2")
def m19_qoe_metric(spark, sf):
    return rounded(M.qoe_metric(V.qoe_events(spark, sf), _users(spark, sf), "time_to_first_frame_ms"))


@query("SELECT user_id, variant_id, round(avg(ebvs_detected::int), 6) AS metric_value FROM qoe_events JOIN eu USING (user_id) GROUP BY 1, 2")
def m20_ebvs_rate(spark, sf):
    return rounded(M.ebvs_rate(V.qoe_events(spark, sf), _users(spark, sf)))


@query("""SELECT variant_id, round(corr(x, y), 6) AS correlation, count(*) AS users, round(avg(x), 6) AS mean_qoe, round(avg(y), 6) AS mean_engagement, round(stddev_samp(x), 6) AS sd_qoe, round(stddev_samp(y), 6) AS sd_engagement FROM
  (SELECT user_id, variant_id, avg(rebuffer_ratio) AS x FROM qoe_events JOIN eu USING (user_id) GROUP BY 1, 2) JOIN (SELECT user_id, avg(value) AS y FROM metric_events WHERE event_type = 'click' GROUP BY 1) USING (user_id) GROUP BY 1""")
def m21_qoe_correlation(spark, sf):
    return rounded(M.qoe_engagement_correlation(V.qoe_events(spark, sf), _events(spark, sf), _users(spark, sf), "rebuffer_ratio", "click"))


@query("SELECT variant_id, content_id, round(sum(value), 4) AS watch_time_seconds, count(*) AS view_count, count(DISTINCT user_id) AS unique_viewers FROM metric_events JOIN eu USING (user_id) WHERE content_id IS NOT NULL GROUP BY 1, 2")
def m22_content_consumption(spark, sf):
    return rounded(M.content_consumption(_events(spark, sf), _users(spark, sf)), 4)


@query("""SELECT computation_date::varchar AS computation_date, round(avg(metric_value) FILTER (variant_id <> 'control'), 6) AS treatment_mean, round(avg(metric_value) FILTER (variant_id = 'control'), 6) AS control_mean, count(*) AS sample_size,
  round(avg(metric_value) FILTER (variant_id <> 'control') - avg(metric_value) FILTER (variant_id = 'control'), 6) AS absolute_effect FROM summaries GROUP BY 1 ORDER BY 1""")
def m23_daily_effect(spark, sf):
    return rounded(M.daily_treatment_effect(V.metric_summaries(spark, sf))).withColumn("computation_date", F.col("computation_date").cast("string")).orderBy("computation_date")


@query("SELECT variant_id, 'value' AS metric_id, round(avg(metric_value), 6) AS avg_value, count(DISTINCT user_id) AS users FROM summaries WHERE computation_date BETWEEN DATE '2024-01-17' AND DATE '2024-01-31' GROUP BY 1 ORDER BY 1")
def m24_surrogate_input(spark, sf):
    return rounded(M.surrogate_input(V.metric_summaries(spark, sf), ["value"], V.END, 14)).orderBy("variant_id", "metric_id")


_CONTAMINATION = """SELECT retraining_event_id, share AS treatment_contamination_fraction,
  avg(metric_value) FILTER (computation_date < retrained_on AND variant_id <> 'control') - avg(metric_value) FILTER (computation_date < retrained_on AND variant_id = 'control') AS pre_effect,
  avg(metric_value) FILTER (computation_date >= retrained_on AND variant_id <> 'control') - avg(metric_value) FILTER (computation_date >= retrained_on AND variant_id = 'control') AS post_effect
  FROM summaries JOIN retrainings ON computation_date >= retrained_on - 7 AND computation_date < retrained_on + 7 GROUP BY 1, 2"""


@query(f"SELECT retraining_event_id, treatment_contamination_fraction::double AS treatment_contamination_fraction, round(pre_effect, 6) AS pre_effect, round(post_effect, 6) AS post_effect FROM ({_CONTAMINATION})")
def m25_feedback_contamination(spark, sf):
    return rounded(M.feedback_loop_contamination(V.metric_summaries(spark, sf), V.model_retraining_events(spark)))


_FEATURES = """features AS (SELECT eu.user_id, variant_id, round(coalesce(avg(value) FILTER (event_type = 'view'), 0), 6) AS view, round(coalesce(avg(value) FILTER (event_type = 'click'), 0), 6) AS click, (eu.user_id % 5 + 1)::int AS fold
  FROM eu LEFT JOIN (SELECT * FROM metric_events WHERE event_date >= DATE '2024-01-01' AND event_date < DATE '2024-01-08') USING (user_id) GROUP BY 1, 2)"""


def _features(spark, sf):
    return rounded(M.mlrate_features(_events(spark, sf), _users(spark, sf), ["view", "click"], V.START, 7, 5, F.col("user_id") % 5 + 1))


@query(f"WITH {_FEATURES} SELECT * FROM features")
def m26_mlrate_features(spark, sf):
    return _features(spark, sf)


@query(f"""WITH {_FEATURES}, obs AS (SELECT f.*, y FROM features f JOIN (SELECT user_id, avg(value) AS y FROM metric_events WHERE event_date >= DATE '2024-01-08' GROUP BY 1) USING (user_id)),
  fits AS (SELECT a.fold, regr_slope(b.y, b.view) AS slope, regr_intercept(b.y, b.view) AS intercept FROM (SELECT DISTINCT fold FROM obs) a JOIN obs b ON a.fold <> b.fold GROUP BY 1)
  SELECT user_id, variant_id, fold, round(intercept + slope * view, 5) AS predicted FROM obs JOIN fits USING (fold)""")
def m27_crossfit_predict(spark, sf):
    y = _events(spark, sf).filter(F.col("event_date") >= F.lit(V.START).cast("date")).groupBy("user_id").agg(F.avg("value").alias("y"))
    return rounded(M.crossfit_predict(_features(spark, sf).join(y, "user_id"), "y", "view").select("user_id", "variant_id", "fold", "predicted"), 5)


_CLICKS = """clicks AS (SELECT user_id, CASE WHEN content_id % 2 = 0 THEN 'algo_a' ELSE 'algo_b' END AS algorithm, count(*) AS n FROM metric_events JOIN eu USING (user_id) WHERE event_type = 'click' GROUP BY 1, 2)"""


def _interleaving(spark, sf, credit):
    return M.interleaving_scores(_events(spark, sf), _users(spark, sf), F.when(F.col("content_id") % 2 == 0, "algo_a").otherwise("algo_b"), "click", credit)


@query(f"""WITH {_CLICKS} SELECT user_id, round(coalesce(max(p) FILTER (algorithm = 'algo_a'), 0), 6) AS score_a, round(coalesce(max(p) FILTER (algorithm = 'algo_b'), 0), 6) AS score_b,
  CASE WHEN count(*) FILTER (n = top) = 1 THEN max(algorithm) FILTER (n = top) END AS winner, sum(n)::bigint AS engagements
  FROM (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p, max(n) OVER (PARTITION BY user_id) AS top FROM clicks) GROUP BY 1""")
def m28_interleaving_score(spark, sf):
    score = lambda a: F.coalesce(F.try_element_at("algorithm_scores", F.lit(a)), F.lit(0.0))
    s = _interleaving(spark, sf, "proportional")
    return rounded(s.select("user_id", score("algo_a").alias("score_a"), score("algo_b").alias("score_b"), F.col("winning_algorithm_id").alias("winner"), F.col("total_engagements").alias("engagements")))


@query("WITH pairs AS (SELECT content_id, variant_id, n FROM (SELECT content_id, variant_id, count(*) AS n FROM metric_events JOIN eu USING (user_id) GROUP BY 1, 2)) SELECT coalesce(c.content_id, t.content_id) AS content_id, coalesce(c.n, 0) AS control_n, coalesce(t.n, 0) AS t1_n FROM (SELECT * FROM pairs WHERE variant_id = 'control') c FULL JOIN (SELECT * FROM pairs WHERE variant_id = 't1') t ON c.content_id = t.content_id")
def j12_full_outer_join(spark, sf):
    counts = C.impressions(_events(spark, sf), _users(spark, sf))
    side = lambda v, a: counts.filter(F.col("variant_id") == v).select("content_id", F.col("n").alias(a))
    return side("control", "control_n").join(side("t1", "t1_n"), "content_id", "full_outer").fillna(0, ["control_n", "t1_n"])


@query("SELECT user_id, content_id, event_id, round(value, 6) AS value, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM metric_events) WHERE rank <= 3")
def o2_top_k_per_group(spark, sf):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return rounded(_events(spark, sf).select("user_id", "content_id", "event_id", "value", rank.alias("rank")).filter("rank <= 3"))


@query("SELECT user_id, arg_max(content_id, (value, -event_id)) AS best_content FROM metric_events GROUP BY 1")
def o3_arg_max(spark, sf):
    return _events(spark, sf).groupBy("user_id").agg(F.max_by("content_id", F.struct("value", -F.col("event_id"))).alias("best_content"))


@query("SELECT variant_id, content_id, n, row_number() OVER (PARTITION BY variant_id ORDER BY n, content_id) AS rank, sum(n) OVER (PARTITION BY variant_id)::bigint AS arm_total, count(*) OVER (PARTITION BY variant_id) AS arm_items, round(percent_rank() OVER (ORDER BY n DESC), 6) AS share_rank FROM (SELECT variant_id, content_id, count(*) AS n FROM metric_events JOIN eu USING (user_id) WHERE content_id IS NOT NULL GROUP BY 1, 2)")
def w1_w3_windows(spark, sf):
    counts = C.impressions(_events(spark, sf), _users(spark, sf))
    arms = counts.groupBy("variant_id").agg(F.sum("n").alias("arm_total"), F.count("*").alias("arm_items"))
    ranked = earlier_sums(C.popularity(counts, "n"), ["variant_id"], ["n", "content_id"], "n").join(F.broadcast(arms), "variant_id")  # a row an arm
    return rounded(ranked.select("variant_id", "content_id", "n", (F.col("n_before") + 1).alias("rank"), "arm_total", "arm_items", F.col("place").alias("share_rank")))


@query("SELECT user_id, session_no, count(*) AS events, round(sum(value), 4) AS total FROM sessions GROUP BY 1, 2")
def w8_gap_sessions(spark, sf):
    return rounded(V.sessions(spark, sf).groupBy("user_id", "session_no").agg(F.count("*").alias("events"), F.sum("value").alias("total")), 4)


@query("""WITH hb AS (SELECT event_id, user_id, user_id % 2 AS device_id, content_id, event_timestamp AS t, event_type = 'signup' AS st, event_type = 'error' AS rb, 1000 + 10 * content_id AS br, [480, 720, 1080][content_id % 3 + 1] AS h FROM metric_events),
  o AS (SELECT *, CASE WHEN t > lag(t) OVER w + INTERVAL 72 HOUR THEN 1 ELSE 0 END AS opens FROM hb WINDOW w AS (PARTITION BY user_id, device_id, content_id ORDER BY t, event_id)),
  s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id, device_id, content_id ORDER BY t, event_id)::bigint AS session_no FROM o),
  f AS (SELECT *, (rb AND NOT coalesce(lag(rb) OVER w, false))::int AS stalls, (h <> coalesce(lag(h) OVER w, h))::int AS switches FROM s WINDOW w AS (PARTITION BY user_id, device_id, content_id, session_no ORDER BY t, event_id)),
  g AS (SELECT user_id, device_id, content_id, session_no, epoch_us(min(t)) AS first, epoch_us(max(t)) AS last, epoch_us(min(t) FILTER (NOT st)) AS playing, sum(stalls)::bigint AS rebuffer_count, round(avg(rb::int), 6) AS rebuffer_ratio, round(avg(br), 6) AS avg_bitrate_kbps, sum(switches)::bigint AS resolution_switches, max(h) AS peak_resolution_height, count(*) AS beats FROM f GROUP BY 1, 2, 3, 4),
  r AS (SELECT *, CASE WHEN playing IS NULL THEN 0 ELSE floor((last - playing) / 1000.0)::bigint END AS playback_duration_ms, CASE WHEN playing IS NULL THEN 0 ELSE floor((playing - first) / 1000.0)::bigint END AS time_to_first_frame_ms FROM g)
  SELECT user_id, device_id, content_id, session_no, concat_ws('-', user_id, device_id, content_id, session_no) AS session_id, playback_duration_ms, time_to_first_frame_ms, rebuffer_count, rebuffer_ratio, avg_bitrate_kbps, resolution_switches, peak_resolution_height,
  CASE WHEN playing IS NULL THEN 1.0::double ELSE 0.0 END AS startup_failure_rate, beats, playback_duration_ms <= 0 AND (time_to_first_frame_ms <= 0 OR time_to_first_frame_ms > 10000) AS ebvs_detected FROM r""")
def t5_playback_metrics(spark, sf):
    return playback_metrics(V.heartbeats(spark, sf), 72 * 3600)


