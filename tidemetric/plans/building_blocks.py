"""Scans, joins, windows, set operations and scalar functions that the metrics are made of."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemetric.functions import distributions as D
from tidemetric.functions.events import clamped, ebvs_detected, is_finite, json_features, sound_map
from tidemetric.operators import catalog as C
from tidemetric.operators import metrics as M
from tidemetric.operators.exposure import exposed_users
from tidemetric.plans.registry import half_normal_sql, query, rounded
from tidemetric.sources import lake
from tidemetric.sources import views as V
from tidemetric.sources.store import append_run_log, check_fresh, shared_folder, write_partitions


def _users(spark, sf):
    return exposed_users(V.exposures(spark, sf))


@query("SELECT event_type, event_date::varchar AS event_date, count(*) AS n, round(sum(value), 3) AS total FROM metric_events WHERE event_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' AND event_type IN ('view', 'click') GROUP BY 1, 2")
def s1_partitioned_scan(spark, sf):
    path = shared_folder(spark, "metric-events")
    write_partitions(V.metric_events(spark, sf).withColumn("event_date", F.col("event_date").cast("string")), path, "event_date", "event_type")
    rows = spark.read.parquet(path).filter("event_date between '2024-01-10' and '2024-01-12' and event_type in ('view', 'click')")
    return rounded(rows.groupBy("event_type", F.col("event_date").cast("string").alias("event_date")).agg(F.count("*").alias("n"), F.sum("value").alias("total")), 3)


@query("SELECT genre, count(*) AS contents, count(DISTINCT provider_id) AS providers FROM content_catalog GROUP BY 1")
def s2_catalog_scan(spark, sf):
    return V.content_catalog(spark, sf).groupBy("genre").agg(F.count("*").alias("contents"), F.count_distinct("provider_id").alias("providers"))


@query("SELECT variant_id, lifecycle_segment, count(*) AS n, round(avg(metric_value), 6) AS mean, round(avg(cuped_covariate), 6) AS covariate FROM summaries GROUP BY 1, 2")
def s3_metric_summaries(spark, sf):
    path = shared_folder(spark, "summaries")
    write_partitions(V.metric_summaries(spark, sf), path, "computation_date", "experiment_id")
    rows = lake.read_metric_summaries(spark, path, "exp")
    return rounded(rows.groupBy("variant_id", "lifecycle_segment").agg(F.count("*").alias("n"), F.avg("metric_value").alias("mean"), F.avg("cuped_covariate").alias("covariate")))


@query("SELECT 'value' AS metric_id, count(DISTINCT computation_date) AS days FROM summaries")
def s5_daily_effects(spark, sf):
    path = shared_folder(spark, "effects")
    daily = M.daily_treatment_effect(V.metric_summaries(spark, sf)).withColumnRenamed("computation_date", "effect_date").withColumn("experiment_id", F.lit("exp"))
    daily.withColumn("metric_id", F.lit("value")).unionByName(daily.filter("effect_date < date '2024-01-12'").withColumn("metric_id", F.lit("other"))).write.parquet(path)
    return lake.read_daily_effects(spark, path, "exp").groupBy("metric_id").agg(F.count("*").alias("days"))


@query("SELECT content_id, round(coalesce(sum(value) FILTER (variant_id = 'control'), 0), 3) AS control_time, round(coalesce(sum(value) FILTER (variant_id <> 'control'), 0), 3) AS treatment_time FROM metric_events JOIN eu USING (user_id) GROUP BY 1")
def s6_split_consumption(spark, sf):
    return rounded(lake.split_consumption(M.content_consumption(V.metric_events(spark, sf), _users(spark, sf))), 3)


@query("SELECT event_date::varchar AS day, count(*) AS n FROM metric_events GROUP BY 1")
def s10_idempotent_sink(spark, sf):
    path = shared_folder(spark, "sink")
    rows = V.metric_events(spark, sf).withColumn("day", F.col("event_date").cast("string")).select("event_id", "day")
    write_partitions(rows, path, "day")
    write_partitions(rows.filter("day = '2024-01-21'"), path, "day")
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT 'exp' AS experiment_id, 'view_mean' AS metric_id, count(DISTINCT user_id) AS row_count, 'daily' AS job_type FROM metric_events JOIN eu USING (user_id) WHERE event_type = 'view'")
def s12_run_log(spark, sf):
    path = shared_folder(spark, "log")
    rows = M.mean(V.metric_events(spark, sf), _users(spark, sf), "view").count()
    append_run_log(spark, path, [("exp", "view_mean", rows, 0.0, "daily")])
    return spark.read.parquet(path).drop("seconds")


@query("SELECT count(*) AS contents, true AS fresh FROM content_catalog")
def s13_freshness_gate(spark, sf):
    dated = V.content_catalog(spark, sf).withColumn("updated_at", F.lit("2024-01-30 12:00:00").cast("timestamp") - F.make_interval(hours=F.col("content_id")))
    check_fresh(dated, "2024-01-31 00:00:00")
    return dated.agg(F.count("*").alias("contents")).withColumn("fresh", F.lit(True))


@query("SELECT user_id, CASE WHEN sum(value) > 3000 THEN 'high' WHEN sum(value) > 1000 THEN 'mid' ELSE 'low' END AS band, round(sum(value) / nullif(count(*) FILTER (event_type = 'signup'), 0), 4) AS per_signup, coalesce(max(value) FILTER (event_type = 'none'), 0.0)::double AS filled FROM metric_events GROUP BY 1")
def p7_derived_columns(spark, sf):
    signups = F.count(F.when(F.col("event_type") == "signup", 1))
    out = V.metric_events(spark, sf).groupBy("user_id").agg(F.sum("value").alias("s"), signups.alias("k"), F.max(F.when(F.col("event_type") == "none", F.col("value"))).alias("m"))
    band = F.when(F.col("s") > 3000, "high").when(F.col("s") > 1000, "mid").otherwise("low")
    return rounded(out.select("user_id", band.alias("band"), F.try_divide("s", F.nullif("k", F.lit(0))).alias("per_signup"), F.coalesce("m", F.lit(0.0)).alias("filled")), 4)


@query("SELECT content_id, round(count(*)::double / (SELECT count(*) FROM metric_events), 6) AS share FROM metric_events GROUP BY 1")
def j7_scalar_join(spark, sf):
    e = V.metric_events(spark, sf)
    return rounded(e.groupBy("content_id").agg(F.count("*").alias("n")).crossJoin(e.agg(F.count("*").alias("total"))).select("content_id", (F.col("n") / F.col("total")).alias("share")))


@query("SELECT genre, provider_id, count(*) AS events, count(DISTINCT user_id) AS users FROM metric_events JOIN content_catalog USING (content_id) GROUP BY 1, 2")
def j8_star_join(spark, sf):
    rows = V.metric_events(spark, sf).join(V.content_catalog(spark, sf), "content_id")
    return rows.groupBy("genre", "provider_id").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))


@query("SELECT e.user_id, e.event_id, round(e.value, 6) AS value FROM metric_events e JOIN (SELECT user_id, max(value) AS m FROM metric_events GROUP BY 1) g ON e.user_id = g.user_id AND e.value = g.m")
def j10_group_max(spark, sf):
    top = F.max("value").over(Window.partitionBy("user_id"))
    return rounded(V.metric_events(spark, sf).withColumn("top", top).filter("value = top").select("user_id", "event_id", "value"))


@query("SELECT user_id, round(a.v, 6) AS pre, round(b.v, 6) AS post FROM (SELECT user_id, avg(value) AS v FROM metric_events WHERE event_date < DATE '2024-01-08' GROUP BY 1) a JOIN (SELECT user_id, avg(value) AS v FROM metric_events WHERE event_date >= DATE '2024-01-08' GROUP BY 1) b USING (user_id)")
def j11_pre_post_join(spark, sf):
    before = F.col("event_date") < F.lit(V.START).cast("date")
    both = V.metric_events(spark, sf).groupBy("user_id").agg(F.avg(F.when(before, F.col("value"))).alias("pre"), F.avg(F.when(~before, F.col("value"))).alias("post"))
    return rounded(both.filter("pre is not null and post is not null"))


@query("SELECT user_id, CASE WHEN content_id % 3 = 0 THEN 'algo_a' WHEN content_id % 3 = 1 THEN 'algo_b' END AS algorithm, count(*) AS n FROM metric_events GROUP BY 1, 2")
def j13_map_lookup(spark, sf):
    provenance = F.map_from_entries(F.transform(F.filter(F.sequence(F.lit(0), F.lit(99)), lambda k: k % 3 < 2), lambda k: F.struct(k.alias("k"), F.when(k % 3 == 0, "algo_a").otherwise("algo_b").alias("v"))))
    return V.metric_events(spark, sf).withColumn("algorithm", F.try_element_at(provenance, F.col("content_id"))).groupBy("user_id", "algorithm").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, round(avg(value) OVER w, 6) AS prior_mean, round(sum(value) OVER r, 3) AS running_total FROM metric_events WINDOW w AS (PARTITION BY user_id ORDER BY event_timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r AS (PARTITION BY user_id ORDER BY event_timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def w4_running_windows(spark, sf):
    own = Window.partitionBy("user_id").orderBy("event_timestamp", "event_id")
    rows = V.metric_events(spark, sf)
    return rounded(rows.select("user_id", "event_id", F.round(F.avg("value").over(own.rowsBetween(Window.unboundedPreceding, -1)), 6).alias("prior_mean"), F.round(F.sum("value").over(own.rowsBetween(Window.unboundedPreceding, 0)), 3).alias("running_total")))


@query("SELECT user_id, count(*) AS pairs, round(sum((value - m) * (prior - m)) / sum((value - m) * (value - m)), 6) AS lag1 FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_timestamp, event_id) AS prior, avg(value) OVER (PARTITION BY user_id) AS m FROM metric_events) GROUP BY 1")
def w5_lag_autocovariance(spark, sf):
    own = Window.partitionBy("user_id")
    rows = V.metric_events(spark, sf).select("user_id", "value", F.lag("value").over(own.orderBy("event_timestamp", "event_id")).alias("prior"), F.avg("value").over(own).alias("m"))
    d = F.col("value") - F.col("m")
    return rounded(rows.groupBy("user_id").agg(F.count("*").alias("pairs"), F.try_divide(F.sum(d * (F.col("prior") - F.col("m"))), F.sum(d * d)).alias("lag1")))


@query("SELECT user_id, n AS days, span, n = span AS unbroken FROM (SELECT user_id, count(DISTINCT event_date) AS n, (max(event_date) - min(event_date) + 1)::int AS span FROM metric_events GROUP BY 1)")
def w9_consecutive_days(spark, sf):
    out = V.metric_events(spark, sf).groupBy("user_id").agg(F.count_distinct("event_date").alias("days"), (F.datediff(F.max("event_date"), F.min("event_date")) + 1).alias("span"))
    return out.withColumn("unbroken", F.col("days") == F.col("span"))


@query("SELECT count(*) AS pairs FROM (SELECT DISTINCT user_id, content_id FROM metric_events)")
def x1_distinct(spark, sf):
    return V.metric_events(spark, sf).select("user_id", "content_id").distinct().agg(F.count("*").alias("pairs"))


@query("WITH imp AS (SELECT variant_id, content_id FROM metric_events JOIN eu USING (user_id) GROUP BY 1, 2), a AS (SELECT content_id FROM imp WHERE variant_id = 'control'), b AS (SELECT content_id FROM imp WHERE variant_id = 't1') SELECT (SELECT count(*) FROM a JOIN b USING (content_id)) AS shared, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either")
def x2_set_overlap(spark, sf):
    counts = C.impressions(V.metric_events(spark, sf), _users(spark, sf)).filter(F.col("variant_id").isin("control", "t1"))
    arms = counts.groupBy("content_id").agg(F.count("*").alias("arms"))
    return arms.agg(F.count(F.when(F.col("arms") == 2, 1)).alias("shared"), F.count("*").alias("either"))


@query("SELECT event_id, (event_date - 7)::varchar AS week_before, (event_date + 3)::varchar AS later, strftime(event_timestamp + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M') AS plus, round(ln(1 + value), 6) AS log_value, round(power(value, 2), 4) AS squared, abs(content_id - 50) AS distance, content_id % 7 AS fold FROM metric_events")
def f1_f2_scalar_functions(spark, sf):
    e = V.metric_events(spark, sf)
    return rounded(e.select(
        "event_id", F.date_sub("event_date", 7).cast("string").alias("week_before"), F.date_add("event_date", 3).cast("string").alias("later"), F.date_format(F.col("event_timestamp") + F.expr("INTERVAL 36 HOURS"), "yyyy-MM-dd HH:mm").alias("plus"),
        F.ln(1 + F.col("value")).alias("log_value"), F.round(F.pow("value", F.lit(2)), 4).alias("squared"), F.abs(F.col("content_id") - 50).alias("distance"), F.pmod("content_id", F.lit(7)).alias("fold"),
    ))


@query("SELECT user_id, count(*) AS kinds, coalesce(max(n) FILTER (event_type = 'view'), 0) AS views, count(*) FILTER (event_type = 'purchase') > 0 AS buys FROM (SELECT user_id, event_type, count(*) AS n FROM metric_events GROUP BY 1, 2) GROUP BY 1")
def f5_f6_maps_and_arrays(spark, sf):
    n = V.metric_events(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", F.size("m").cast("long").alias("kinds"), F.coalesce(F.try_element_at("m", F.lit("view")), F.lit(0)).alias("views"), F.array_contains(F.map_keys("m"), "purchase").alias("buys"))


@query("SELECT CAST(props->>'$.k' AS DOUBLE) AS k, count(*) AS n FROM events GROUP BY 1", views=False)
def f9_json_features(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.select(F.try_element_at(json_features(F.col("props")), F.lit("k")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT ebvs_detected, count(*) AS n FROM qoe_events GROUP BY 1")
def f10_ebvs_rule(spark, sf):
    q = V.qoe_events(spark, sf).withColumn("ebvs_detected", ebvs_detected(F.col("playback_duration_ms"), F.col("time_to_first_frame_ms")))
    return q.groupBy("ebvs_detected").agg(F.count("*").alias("n"))


@query("SELECT event_id, round(least(100, greatest(5, value)), 4) AS held, true AS finite, event_type <> 'error' AS tagged FROM metric_events")
def f11_clamp_and_checks(spark, sf):
    tags = F.create_map(F.lit("type"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")))
    return rounded(V.metric_events(spark, sf).select("event_id", clamped(F.col("value"), 5.0, 100.0).alias("held"), is_finite(F.col("value")).alias("finite"), sound_map(tags).alias("tagged")), 4)


@query("SELECT CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant_id, count(*) AS users, true AS near FROM (SELECT DISTINCT user_id FROM metric_events) GROUP BY 1")
def s14_synthetic_arms(spark, sf):
    users = V.metric_events(spark, sf).select("user_id").distinct()
    drawn = lake.synthetic_arms(users, "poisson").groupBy("variant_id").agg(F.count("*").alias("users"), F.avg("value").alias("mean"))
    rate = F.when(F.col("variant_id") == "treatment", 5.0).otherwise(3.0)
    return drawn.select("variant_id", "users", (F.abs(F.col("mean") - rate) <= 4 * F.sqrt(rate / F.col("users"))).alias("near"))


@query("WITH c AS (SELECT user_id, CASE WHEN content_id % 2 = 0 THEN 'algo_a' ELSE 'algo_b' END AS algorithm, count(*) AS n FROM metric_events JOIN eu USING (user_id) WHERE event_type = 'click' GROUP BY 1, 2) SELECT 'exp' AS experiment_id, user_id::varchar AS user_id, algorithm, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS score FROM c")
def s4_interleaving_scores(spark, sf):
    scores = M.interleaving_scores(V.metric_events(spark, sf), _users(spark, sf), F.when(F.col("content_id") % 2 == 0, "algo_a").otherwise("algo_b"), "click", "proportional")
    path = shared_folder(spark, "interleaving-scores")
    scores.select(F.lit("exp").alias("experiment_id"), F.col("user_id").cast("string").alias("user_id"), "algorithm_scores", "winning_algorithm_id", F.lit(0).alias("total_engagements"), F.to_date(F.lit(V.START)).alias("computation_date")).write.parquet(path)
    return rounded(lake.read_interleaving_scores(spark, path, "exp").select("experiment_id", "user_id", "algorithm", "score"))


@query("SELECT 'exp' AS experiment_id, 'value' AS metric_id, block AS period_id, round(avg(value), 6) AS value, (block % 2)::bigint AS is_treatment, row_number() OVER (ORDER BY block)::int AS at FROM (SELECT value, floor(epoch_us(event_timestamp) / 1000000.0 / 43200)::bigint AS block FROM metric_events) GROUP BY block")
def s7_switchback_periods(spark, sf):
    block = F.floor(F.unix_micros(F.col("event_timestamp").cast("timestamp")) / 1_000_000 / 43_200)
    series = V.metric_events(spark, sf).groupBy(block.cast("long").alias("period_id")).agg(F.avg("value").alias("value"))
    path = shared_folder(spark, "switchback-periods")
    series.select(F.lit("exp").alias("experiment_id"), F.lit("value").alias("metric_id"), "period_id", "value", (F.col("period_id") % 2).alias("is_treatment")).write.parquet(path)
    return rounded(lake.read_switchback_periods(spark, path, "exp").select("experiment_id", "metric_id", "period_id", "value", "is_treatment", "at"))


@query("SELECT user_id, round(exp(-x / 2) * (1 + x / 2), 6) AS chi_square_p, round(1 - sqrt(x * x / (2 + x * x)), 6) AS t_p, " + f"round(2 * (0.5 - {half_normal_sql('z')}), 6) AS normal_p" + " FROM (SELECT user_id, (avg(value) / 10)::double AS x, ((avg(value) - 50) / 10)::double AS z FROM metric_events GROUP BY 1)")
def f12_distribution_functions(spark, sf):
    x = V.metric_events(spark, sf).groupBy("user_id").agg((F.avg("value") / 10).alias("x"), ((F.avg("value") - 50) / 10).alias("z"))
    return rounded(x.select("user_id", D.chi_square_p(F.col("x"), F.lit(4.0)).alias("chi_square_p"), D.t_p_value(F.col("x"), F.lit(2.0)).alias("t_p"), D.normal_p_value(F.col("z")).alias("normal_p")))
