"""Analysis, panel, assignment, bandit and off-policy queries over the experiment views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemetric.functions.predicates import targeting
from tidemetric.operators import analysis as A
from tidemetric.operators import assignment as S
from tidemetric.operators import bandit as B
from tidemetric.operators import metrics as M
from tidemetric.operators import offpolicy as O
from tidemetric.operators import panels as P
from tidemetric.operators import resampling as R
from tidemetric.operators.exposure import exposed_users
from tidemetric.plans.inference_queries import observations
from tidemetric.plans.metric_queries import _CLICKS, _CONTAMINATION, _interleaving
from tidemetric.plans.registry import half_normal_sql, query, rounded, t_two_sided_sql
from tidemetric.sources import views as V


def _consumption(spark, sf):
    users = exposed_users(V.exposures(spark, sf))
    return M.content_consumption(V.metric_events(spark, sf), users)


_CONS = "cons AS (SELECT variant_id, content_id, sum(value) AS w, count(*) AS n FROM metric_events JOIN eu USING (user_id) WHERE content_id IS NOT NULL GROUP BY 1, 2)"
_BOTH = _CONS + ", both_arms AS (SELECT coalesce(t.content_id, c.content_id) AS content_id, coalesce(t.w, 0) AS t, coalesce(c.w, 0) AS c FROM (SELECT * FROM cons WHERE variant_id = 't1') t FULL JOIN (SELECT * FROM cons WHERE variant_id = 'control') c ON t.content_id = c.content_id)"


_SPILL = f"tot AS (SELECT variant_id, sum(n) AS total FROM cons GROUP BY 1), r AS (SELECT * FROM cons JOIN tot USING (variant_id)), zs AS (SELECT content_id, (n_t / tt - n_c / tc) / sqrt(p * (1 - p) * (1 / tt + 1 / tc)) AS z FROM (SELECT t.content_id, t.n AS n_t, c.n AS n_c, t.total AS tt, c.total AS tc, (t.n + c.n) / (t.total + c.total) AS p FROM r t JOIN r c USING (content_id) WHERE t.variant_id = 't1' AND c.variant_id = 'control')), ps AS (SELECT *, 1 - 2 * {half_normal_sql('z')} AS p FROM zs), rs AS (SELECT *, row_number() OVER (ORDER BY p, content_id) AS k, count(*) OVER () AS m FROM ps), spill AS (SELECT *, least(1, min(p * m / k) OVER (ORDER BY p, content_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS a FROM rs)"


@query(f"""WITH {_BOTH}, {_SPILL}, s AS (SELECT *, t / sum(t) OVER () AS p, c / sum(c) OVER () AS q, row_number() OVER (ORDER BY t DESC, content_id) AS rt, row_number() OVER (ORDER BY c DESC, content_id) AS rc, row_number() OVER (ORDER BY t, content_id) AS at_, row_number() OVER (ORDER BY c, content_id) AS ac_ FROM both_arms)
  SELECT round(0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END), 6) AS js_divergence,
  round(count(*) FILTER (rt <= 20 AND t > 0 AND rc <= 20 AND c > 0)::double / count(*) FILTER (rt <= 20 AND t > 0 OR rc <= 20 AND c > 0), 6) AS top_jaccard, round(avg((t > 0)::int), 6) AS treatment_coverage, round(avg((c > 0)::int), 6) AS control_coverage,
  round(2 * sum(at_ * t) / (count(*) * sum(t)) - (count(*) + 1.0) / count(*), 6) AS treatment_gini, round(2 * sum(ac_ * c) / (count(*) * sum(c)) - (count(*) + 1.0) / count(*), 6) AS control_gini, (SELECT count(*) FROM spill WHERE a <= 0.05) AS spillover_titles, 0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) > 0.05 OR (SELECT count(*) FROM spill WHERE a <= 0.05) > 0 AS interference_detected FROM s""")
def a25_interference(spark, sf):
    consumption = _consumption(spark, sf)
    return rounded(A.interference_decision(A.consumption_divergence(consumption, "t1", top=20), A.spillover_tests(A.title_spillover(consumption, "t1"))))


@query(f"WITH {_CONS}, {_SPILL} SELECT content_id, round(z, 6) AS z, round(p, 6) AS p_value, round(a, 6) AS p_adjusted, a <= 0.05 AS spills_over FROM spill")
def a26_title_spillover(spark, sf):
    return rounded(A.spillover_tests(A.title_spillover(_consumption(spark, sf), "t1")))


_WINNERS = _CLICKS + ", w AS (SELECT user_id, CASE WHEN count(*) FILTER (n = top) = 1 THEN max(algorithm) FILTER (n = top) END AS winner FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS top FROM clicks) GROUP BY 1)"


@query(f"WITH {_WINNERS} SELECT winner AS algorithm, count(*) AS wins, round(count(*) / sum(count(*)) OVER (), 6) AS win_rate FROM w WHERE winner IS NOT NULL GROUP BY 1")
def a27_win_rates(spark, sf):
    return rounded(A.win_rates(_interleaving(spark, sf, "proportional")))


@query(f"WITH {_WINNERS}, c AS (SELECT count(*) FILTER (winner = 'algo_a') AS a, count(*) FILTER (winner = 'algo_b') AS b, count(winner) AS n FROM w) SELECT n::bigint AS decisive, round(CASE WHEN n = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(generate_series(0, least(a, b)), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) END, 6) AS p_value FROM c")
def a27_win_test(spark, sf):
    return rounded(A.win_test(A.win_rates(_interleaving(spark, sf, "proportional")), ["algo_a", "algo_b"]))


@query(f"WITH {_WINNERS} SELECT w.winner, c.algorithm AS loser, count(*) AS wins FROM w JOIN clicks c USING (user_id) WHERE winner IS NOT NULL AND winner <> algorithm GROUP BY 1, 2")
def a28_pairwise_wins(spark, sf):
    return A.pairwise_wins(_interleaving(spark, sf, "proportional"))


@query()
def a28_bradley_terry(spark, sf):
    return rounded(A.bradley_terry(A.pairwise_wins(_interleaving(spark, sf, "proportional"))), 5)


@query(f"WITH {_CLICKS} SELECT algorithm, round(avg(p), 6) AS mean_credit FROM (SELECT algorithm, n / sum(n) OVER (PARTITION BY user_id) AS p FROM clicks) GROUP BY 1")
def a28b_positive_credit(spark, sf):
    return rounded(A.mean_positive_credit(_interleaving(spark, sf, "proportional")))


@query()
def a19_bayes_beta_binomial(spark, sf):
    obs = observations(spark, sf).withColumn("y", (F.col("y") > 50).cast("double"))
    return R.bayes_beta_binomial(obs, ["metric_id"], 20_000)


def _rows(spark, sf):
    obs = observations(spark, sf)
    return obs.select("variant_id", (F.col("user_id") * 100 + F.dayofmonth("computation_date")).alias("row_id"), "y")


@query()
def a21_bootstrap_percentile(spark, sf):
    return R.percentile_interval(R.bootstrap_replicates(_rows(spark, sf), 300))


@query()
def a22_bootstrap_bca(spark, sf):
    rows = _rows(spark, sf)
    return R.bca_interval(R.bootstrap_replicates(rows, 300), rows)


@query()
def a24_novelty(spark, sf):
    daily = M.daily_treatment_effect(V.metric_summaries(spark, sf)).select(F.lit("value").alias("metric_id"), F.datediff("computation_date", F.lit(V.START)).alias("day"), F.col("absolute_effect").alias("effect"), "sample_size")
    return P.novelty(daily, ["metric_id"])


def _blocks(spark, sf):
    return S.switchback_blocks(V.metric_events(spark, sf).withColumn("experiment_id", F.lit("exp")), "event_timestamp", 43_200, 3_600)


_BLOCKS = "ev AS (SELECT value, floor(epoch_us(event_timestamp) / 1000000.0 / 43200)::bigint AS block, epoch_us(event_timestamp) / 1000000.0 - floor(epoch_us(event_timestamp) / 1000000.0 / 43200) * 43200 < 3600 AS washout FROM metric_events), ser AS (SELECT block, (block % 2)::int AS arm, avg(value) AS value, count(*) AS n FROM ev WHERE NOT washout GROUP BY 1, 2)"


@query("WITH ev AS (SELECT floor(epoch_us(event_timestamp) / 1000000.0 / 43200)::bigint AS block, epoch_us(event_timestamp) / 1000000.0 - floor(epoch_us(event_timestamp) / 1000000.0 / 43200) * 43200 < 3600 AS washout FROM metric_events) SELECT block, (block % 2)::int AS arm, washout, count(*) AS n FROM ev GROUP BY 1, 2, 3")
def as7_switchback_blocks(spark, sf):
    return _blocks(spark, sf).groupBy("block", "arm", "washout").agg(F.count("*").alias("n"))


@query(f"""WITH {_BLOCKS}, b AS (SELECT count(*) AS t, avg(arm) AS dm, regr_slope(value, arm) AS e, regr_intercept(value, arm) AS i, regr_sxx(value, arm) AS sxx FROM ser),
  s AS (SELECT (arm - dm) * (value - i - e * arm) AS s, row_number() OVER (ORDER BY block) AS k FROM ser, b), m AS (SELECT avg(s) AS m FROM s),
  rho AS (SELECT coalesce(sum((x.s - m) * (y.s - m)) / (SELECT sum((s - m) * (s - m)) FROM s, m), 0) AS r FROM s x JOIN s y ON x.k = y.k + 1, m),
  h AS (SELECT least(greatest(ceil(1.1447 * pow(2 * r * r / (1 - r * r) * t, 1.0 / 3)), 1), t - 1)::int AS h FROM rho, b),
  o AS (SELECT sum(CASE WHEN x.k = y.k THEN 1 ELSE 2 * (1 - (y.k - x.k) / (h + 1.0)) END * x.s * y.s) AS o FROM s x JOIN s y ON y.k >= x.k, h WHERE y.k - x.k <= h)
  ,res AS (SELECT value - i - e * arm AS e, row_number() OVER (ORDER BY block) AS k FROM ser, b), ar AS (SELECT (SELECT sum(x.e * y.e) FROM res x JOIN res y ON x.k = y.k + 1) / (SELECT sum(e * e) FROM res) AS r)
  SELECT 'exp' AS experiment_id, t AS blocks, round(e, 6) AS effect, h AS bandwidth, round(sqrt(greatest(0, o) / (sxx * sxx)), 6) AS se, round(r, 6) AS lag1_autocorrelation, round(r * sqrt((t - 2) / (1 - r * r)), 6) AS carry_over_t, round({t_two_sided_sql('(r * sqrt((t - 2) / (1 - r * r)))', '(t - 2)::double')}, 6) AS carry_over_p FROM b, h, o, ar""")
def a29_switchback_effect(spark, sf):
    return rounded(P.switchback_effect(P.switchback_series(_blocks(spark, sf), ["experiment_id"]), ["experiment_id"]))


@query()
def a30_switchback_randomization(spark, sf):
    return P.switchback_randomization(P.switchback_series(_blocks(spark, sf), ["experiment_id"]), ["experiment_id"])


def control_panel(spark, sf):
    """Mean order value per nation and month; nation 0 counts as treated in the last quarter of months."""
    orders, customers = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/customer.parquet")
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    rows = orders.join(customers.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").groupBy(F.col("c_nationkey").alias("unit_id"), month.alias("period")).agg(F.avg("o_totalprice").alias("value"))
    bounds = rows.agg(F.min("period").alias("low"), F.max("period").alias("high"))
    return rows.crossJoin(F.broadcast(bounds)).select(F.lit("exp").alias("experiment_id"), "unit_id", "period", "value", (F.col("unit_id") == 0).alias("is_treated_unit"), (F.col("period") > F.col("low") + (F.col("high") - F.col("low")) * 0.75).alias("is_post"))


@query("SELECT c_nationkey AS unit_id, (year(o_orderdate) * 12 + month(o_orderdate))::int AS period, round(avg(o_totalprice), 4) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2", views=False)
def s8_control_panel(spark, sf):
    return rounded(control_panel(spark, sf).select("unit_id", "period", "value"), 4)


def _scm(method):
    def run(spark, sf):
        return P.synthetic_control(control_panel(spark, sf), method)

    run.__name__ = {"classic": "a31_synthetic_control", "augmented": "a32_augmented_control", "did": "a33_synthetic_did"}[method]
    return query()(run)


a31, a32, a33 = map(_scm, ("classic", "augmented", "did"))


@query()
def a34_trend_counterfactual(spark, sf):
    return rounded(P.trend_counterfactual(control_panel(spark, sf)), 4)


@query("WITH i AS (SELECT variant_id, avg(metric_value) AS v FROM summaries WHERE computation_date BETWEEN DATE '2024-01-17' AND DATE '2024-01-31' GROUP BY 1), s AS (SELECT variant_id, 1.5 + 0.2 * v AS p FROM i), e AS (SELECT a.variant_id, a.p, a.p - b.p AS e FROM s a, s b WHERE b.variant_id = 'control' AND a.variant_id <> 'control') SELECT variant_id, round(p, 6) AS projected, round(e, 6) AS projected_effect, round(e - 1.96 * abs(e) * sqrt(0.36 / 0.64), 6) AS ci_lower, round(e + 1.96 * abs(e) * sqrt(0.36 / 0.64), 6) AS ci_upper FROM e")
def a35_linear_surrogate(spark, sf):
    inputs = M.surrogate_input(V.metric_summaries(spark, sf), ["value"], V.END, 14)
    return rounded(A.linear_surrogate(inputs, {"value": 0.2}, 1.5, 0.64).drop("control_projected"))


def _projections(spark, sf):
    """Per user as a stand-in experiment: early mean as projection, late mean as outcome."""
    s = V.metric_summaries(spark, sf)
    early = F.avg(F.when(F.col("computation_date") < F.lit("2024-01-18").cast("date"), F.col("metric_value")))
    late = F.avg(F.when(F.col("computation_date") >= F.lit("2024-01-18").cast("date"), F.col("metric_value")))
    return s.groupBy(F.col("user_id").alias("experiment_id")).agg(early.alias("projected"), late.alias("actual")).filter("projected is not null and actual is not null")


_PROJ = "pr AS (SELECT user_id, avg(metric_value) FILTER (computation_date < DATE '2024-01-18') AS p, avg(metric_value) FILTER (computation_date >= DATE '2024-01-18') AS a FROM summaries GROUP BY 1), pa AS (SELECT user_id, p, a, p - a AS e FROM pr WHERE p IS NOT NULL AND a IS NOT NULL), cal AS (SELECT count(*) AS n, 1 - sum(e * e) / sum(pow(a - (SELECT avg(a) FROM pa), 2)) AS r2, sqrt(avg(e * e)) AS rmse, avg(e) AS bias, stddev_samp(e) AS sd FROM pa)"


@query(f"WITH {_PROJ} SELECT n, round(greatest(0, r2), 6) AS r_squared FROM cal")
def a36_recalibration(spark, sf):
    p = _projections(spark, sf)
    return rounded(A.surrogate_recalibration(p.withColumnRenamed("projected", "projected_effect"), p.withColumnRenamed("actual", "actual_effect"), 0.5))


@query(f"WITH {_PROJ} SELECT n, round(r2, 6) AS r_squared, round(rmse, 6) AS rmse, round(bias, 6) AS bias, round(sd, 6) AS error_sd, CASE WHEN r2 >= 0.7 THEN 'green' WHEN r2 >= 0.5 THEN 'yellow' ELSE 'red' END AS badge FROM cal")
def a37_calibration(spark, sf):
    return rounded(A.surrogate_calibration(_projections(spark, sf)))


@query(f"WITH {_PROJ} SELECT user_id AS experiment_id, round(p - bias, 6) AS adjusted, round(p - bias - 1.96 * sqrt(4 + sd * sd), 6) AS ci_lower, round(p - bias + 1.96 * sqrt(4 + sd * sd), 6) AS ci_upper FROM pa, cal")
def a38_adjust_projection(spark, sf):
    p = _projections(spark, sf)
    return rounded(A.adjust_projections(p.withColumn("se", F.lit(2.0)), A.surrogate_calibration(p)).select("experiment_id", "adjusted", "ci_lower", "ci_upper"))


@query(f"WITH {_PROJ} SELECT count(*) AS n, round(avg((a BETWEEN p - 15 AND p + 15)::int), 6) AS coverage, round(avg(abs(e)), 6) AS mae, round(quantile_cont(abs(e) / abs(a), 0.5), 6) AS median_ape, round(avg((abs(e) / abs(a) <= 0.25)::int), 6) AS within_quarter FROM pa")
def a39_backtest(spark, sf):
    p = _projections(spark, sf).withColumns({"ci_lower": F.col("projected") - 15, "ci_upper": F.col("projected") + 15})
    return rounded(A.backtest_surrogate(p).drop("passes"))


_IV = "iv AS (SELECT user_id, (variant_id <> 'control')::int AS z, cuped_covariate AS s, metric_value AS y, user_id % 5 AS fold FROM summaries)"


@query(f"""WITH {_IV}, f AS (SELECT a.fold, regr_slope(b.s, b.z) AS a, regr_intercept(b.s, b.z) AS b FROM (SELECT DISTINCT fold FROM iv) a JOIN iv b ON a.fold <> b.fold GROUP BY 1),
  h AS (SELECT z, s, y, f.b + f.a * z AS h FROM iv JOIN f USING (fold)) SELECT count(*) AS n, round(covar_pop(h, y) / covar_pop(h, s), 4) AS gamma, round(regr_slope(y, s), 6) AS ols_slope, round(pow(corr(z, s), 2) * (count(*) - 2) / (1 - pow(corr(z, s), 2)), 4) AS first_stage_f FROM h""")
def a40_kfold_iv(spark, sf):
    s = V.metric_summaries(spark, sf).select("user_id", (F.col("variant_id") != "control").cast("int").alias("z"), F.col("cuped_covariate").alias("s"), F.col("metric_value").alias("y"))
    out = O.kfold_iv(s, 5, F.col("user_id") % 5)
    return out.select("n", F.round("gamma", 4).alias("gamma"), F.round("ols_slope", 6).alias("ols_slope"), F.round("first_stage_f", 4).alias("first_stage_f"))


def _trajectories(spark, sf):
    e = V.exposures(spark, sf).select("experiment_id", "event_id", "user_id", "event_date", "variant_id", "assignment_probability").join(V.metric_events(spark, sf).select("event_id", "event_type", "value"), "event_id")
    return O.user_trajectories(e, "event_date", (F.col("variant_id") != "control").cast("int"), (F.col("event_type") == "purchase").cast("double"), F.col("assignment_probability"))


@query("SELECT user_id, row_number() OVER w::int AS trajectory_step, n AS events, round(v, 6) AS mean_value, (variant_id <> 'control')::int AS action_id, reward, lead(n) OVER w AS next_events, round(p, 6) AS logging_probability FROM (SELECT x.user_id, x.event_date, any_value(variant_id) AS variant_id, count(*)::double AS n, avg(value) AS v, count(*) FILTER (event_type = 'purchase')::double AS reward, max(assignment_probability) AS p FROM exposures x JOIN metric_events USING (event_id) GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY event_date)")
def a41_user_trajectories(spark, sf):
    t = _trajectories(spark, sf)
    return rounded(t.select("user_id", "trajectory_step", F.get("state_features", F.lit(0)).alias("events"), F.get("state_features", F.lit(1)).alias("mean_value"), "action_id", "reward", F.get("next_state_features", F.lit(0)).alias("next_events"), "logging_probability"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, 0.5 + (content_id % 10) / 7.0 AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM metric_events),
  f(user_id, event_id, k, rho) AS (SELECT user_id, event_id, k, least(5, r)::double FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, least(5, f.rho * e.r) FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
  SELECT event_id, user_id, round(rho, 6) AS rho FROM f""")
def w7_clipped_ratios(spark, sf):
    steps = V.metric_events(spark, sf).select("user_id", "event_id", (0.5 + F.col("content_id") % 10 / 7.0).alias("ratio"))
    return rounded(O.clipped_ratios(steps, ["user_id"], "event_id", "ratio", 5.0).select("event_id", "user_id", "rho"))


@query()
def a42_dr_off_policy(spark, sf):
    return rounded(O.dr_off_policy(_trajectories(spark, sf), 5, 2, 0.95, 10.0, F.lit(0.5)))


@query(f"WITH k AS (SELECT *, post_effect - pre_effect AS ch FROM ({_CONTAMINATION})) SELECT count(*) AS n, round(avg(ch), 6) AS mean_change, round(corr(post_effect, treatment_contamination_fraction), 6) AS correlation, round(regr_slope(post_effect, treatment_contamination_fraction), 6) AS slope, round(regr_intercept(post_effect, treatment_contamination_fraction), 6) AS corrected_effect, round(avg(ch) / (stddev_samp(ch) / sqrt(count(*))), 6) AS t, round(any_value(p), 6) AS p_value, any_value(p < 0.05 AND abs(r) > 0.5 OR p < 0.025) AS detected FROM k, (SELECT r, {t_two_sided_sql('t', 'df')} AS p FROM (SELECT corr(post_effect, treatment_contamination_fraction) AS r, avg(ch) / (stddev_samp(ch) / sqrt(count(*))) AS t, count(*) - 1 AS df FROM k))")
def a43_feedback_loop(spark, sf):
    return rounded(A.feedback_decision(A.feedback_loop(M.feedback_loop_contamination(V.metric_summaries(spark, sf), V.model_retraining_events(spark)))))


@query("""WITH c AS (SELECT variant_id, event_date AS d, avg(value) AS v FROM metric_events JOIN eu USING (user_id) WHERE event_type = 'error' GROUP BY 1, 2), f AS (SELECT *, v > 50 AS b, sum((NOT (v > 50))::int) OVER (PARTITION BY variant_id ORDER BY d) AS g FROM c)
  SELECT variant_id, min(d)::varchar AS since, max(d)::varchar AS until, count(*) AS run FROM f WHERE b GROUP BY variant_id, g HAVING count(*) >= 3""")
def a44_guardrail_breach(spark, sf):
    users = exposed_users(V.exposures(spark, sf))
    e = V.metric_events(spark, sf).filter("event_type = 'error'").join(users, "user_id")
    checks = e.groupBy("variant_id", F.col("event_date").alias("check_time")).agg(F.avg("value").alias("current_value")).withColumns({"experiment_id": F.lit("exp"), "metric_id": F.lit("error")})
    return A.guardrail_breaches(checks, 50, True, 3).select("variant_id", F.col("since").cast("string").alias("since"), F.col("until").cast("string").alias("until"), "run")


def _shadow(spark, sf):
    base = V.metric_summaries(spark, sf).groupBy("variant_id", F.col("computation_date").alias("metric_date")).agg(F.avg("metric_value").alias("metric_value")).withColumn("shadow_id", F.lit("s"))
    other = base.filter("variant_id <> 't2' or day(metric_date) <> 20").withColumn("metric_value", F.col("metric_value") + F.when((F.col("variant_id") == "t1") & (F.dayofmonth("metric_date") == 15), 0.5).otherwise(0.0))
    return A.shadow_diff(base, other)


@query("WITH b AS (SELECT variant_id, computation_date AS d, avg(metric_value) AS v FROM summaries GROUP BY 1, 2), o AS (SELECT variant_id, d, v + CASE WHEN variant_id = 't1' AND day(d) = 15 THEN 0.5 ELSE 0 END AS v FROM b WHERE variant_id <> 't2' OR day(d) <> 20) SELECT b.variant_id, b.d::varchar AS metric_date, round(abs(o.v - b.v) / greatest(abs(b.v), 1), 6) AS relative_error, coalesce(abs(o.v - b.v) / greatest(abs(b.v), 1) <= 1e-9, false) AS passes FROM b LEFT JOIN o USING (variant_id, d)")
def a45_shadow_diff(spark, sf):
    return rounded(_shadow(spark, sf).select("variant_id", F.col("metric_date").cast("string").alias("metric_date"), "relative_error", "passes"))


@query("SELECT shadow, n AS days, span, CASE WHEN n < 7 THEN 'pending' WHEN ok AND n = span THEN 'approved' ELSE 'rejected' END AS status FROM (SELECT variant_id AS shadow, count(DISTINCT computation_date) AS n, (max(computation_date) - min(computation_date) + 1)::int AS span, bool_and(variant_id <> 't1' OR day(computation_date) <> 15) AS ok FROM summaries GROUP BY 1)")
def a46_shadow_promotion(spark, sf):
    diffs = _shadow(spark, sf).withColumn("passes", (F.col("variant_id") != "t1") | (F.dayofmonth("metric_date") != 15)).withColumn("shadow_id", F.col("variant_id"))
    return A.shadow_promotion(diffs).select(F.col("shadow_id").alias("shadow"), "days", "span", "status")


_RES = "res AS (SELECT user_id, avg(metric_value) - 50 AS effect, round((user_id % 20) / 100.0, 2) AS p_value, round((user_id % 11) / 10.0, 1) AS power, user_id % 13 = 0 AS br, round((user_id % 15) / 10.0, 1) AS el FROM summaries GROUP BY 1)"


def _results(spark, sf):
    u = F.col("user_id")
    return V.metric_summaries(spark, sf).groupBy("user_id").agg((F.avg("metric_value") - 50).alias("effect")).select(
        F.col("user_id").alias("experiment_id"), "effect", F.round(u % 20 / 100.0, 2).alias("p_value"), F.round(u % 11 / 10.0, 1).alias("power"), (u % 13 == 0).alias("guardrail_breached"), F.round(u % 15 / 10.0, 1).alias("elapsed"), F.lit(1000).alias("daily_users")
    )


@query(f"""WITH {_RES} SELECT user_id AS experiment_id, CASE WHEN p_value < 0.05 AND effect > 0 THEN 'winner' WHEN p_value < 0.05 THEN 'loser' WHEN power >= 0.8 THEN 'null' WHEN p_value < 0.1 THEN 'directional' ELSE 'inconclusive' END AS learning,
  CASE WHEN br THEN 'stop' WHEN p_value < 0.05 AND effect > 0 THEN 'ship' WHEN p_value < 0.05 THEN 'stop' WHEN el >= 1 THEN 'stop' WHEN el >= 0.5 AND power < 0.5 THEN 'extend' ELSE 'continue' END AS decision, round(effect * 365000, 2) AS annual_impact FROM res""")
def a48_portfolio_outcomes(spark, sf):
    return rounded(A.portfolio_outcomes(_results(spark, sf)).select("experiment_id", "learning", "decision", "annual_impact"), 2)


@query(f"WITH {_RES}, o AS (SELECT user_id % 4 AS layer, CASE WHEN p_value < 0.05 AND effect > 0 THEN 1 ELSE 0 END AS won, effect * 365000 AS impact FROM res) SELECT layer, count(*) AS experiments, round(avg(won), 6) AS win_rate, round(sum(impact) FILTER (won = 1), 2) AS annual_impact FROM o GROUP BY 1")
def a48_portfolio_summary(spark, sf):
    outcomes = A.portfolio_outcomes(_results(spark, sf)).withColumn("layer", F.col("experiment_id") % 4)
    return A.portfolio_summary(outcomes, ["layer"]).select("layer", "experiments", F.round("win_rate", 6).alias("win_rate"), F.round("annual_impact", 2).alias("annual_impact"))


@query("WITH x AS (SELECT DISTINCT user_id, user_id % 4 AS layer FROM metric_events), i AS (SELECT user_id, layer, 'm' || (user_id % 9) AS item FROM x UNION SELECT user_id, layer, 'm' || (user_id % 7) FROM x UNION SELECT user_id, layer, 'p' || (user_id % 25) FROM x) SELECT a.layer, a.user_id AS first, b.user_id AS second, count(*) AS shared FROM i a JOIN i b ON a.layer = b.layer AND a.item = b.item AND a.user_id < b.user_id GROUP BY 1, 2, 3")
def a49_portfolio_conflicts(spark, sf):
    u = F.col("user_id")
    e = V.metric_events(spark, sf).select("user_id").distinct().select(u.alias("experiment_id"), (u % 4).alias("layer"), F.array(F.concat(F.lit("m"), (u % 9).cast("string")), F.concat(F.lit("m"), (u % 7).cast("string"))).alias("metrics"), F.array(F.concat(F.lit("p"), (u % 25).cast("string"))).alias("populations"))
    return A.portfolio_conflicts(e)


@query("SELECT user_id % 4 AS layer, round(sum(50 + user_id - user_id + 1) / 10000.0, 6) AS utilisation, count(*) AS experiments FROM (SELECT DISTINCT user_id FROM metric_events) GROUP BY 1")
def a50_traffic_utilisation(spark, sf):
    u = F.col("user_id")
    return rounded(A.traffic_utilisation(V.metric_events(spark, sf).select("user_id").distinct().select((u % 4).alias("layer"), u.alias("first"), (u + 50).alias("last"))))


# --- assignment and bandits --------------------------------------------------------

EXPERIMENTS = [
    S.Experiment("hold", "hold-salt", 0, 499, [("holdout", 1.0)], "home", is_holdout=True),
    S.Experiment("rank", "rank-salt", 0, 7999, [("control", 0.5), ("t1", 0.3), ("t2", 0.2)], "home"),
    S.Experiment("art", "art-salt", 2000, 9999, [("control", 0.5), ("t1", 0.5)], "art", rules=[[("platform", "IN", ["0", "1", "2"])]]),
]


def _murmur_views(salt: str, units: str = "SELECT DISTINCT user_id FROM metric_events", to: str = "hashed") -> str:
    """Views that end in ``to(user_id, h)``: MurmurHash3 of ``user NUL salt``, block by block, for the ``units``."""
    rot = lambda x, n: f"(((({x}) << {n}) | (({x}) >> {32 - n})) & 4294967295)"
    times = lambda x, c: f"((({x})::hugeint * {c}) % 4294967296)::bigint"
    return f"""mb{to} AS (SELECT user_id, list_concat(list_transform(regexp_extract_all(user_id::varchar, '.'), lambda c: ascii(c)::bigint), [0::bigint], list_transform(regexp_extract_all('{salt}', '.'), lambda c: ascii(c)::bigint)) AS b FROM ({units})),
  mk{to} AS (SELECT user_id, len(b) AS n, list_transform(generate_series(0, (len(b) - 1) // 4), lambda k: b[4 * k + 1] + coalesce(b[4 * k + 2], 0) * 256 + coalesce(b[4 * k + 3], 0) * 65536 + coalesce(b[4 * k + 4], 0) * 16777216) AS k FROM mb{to}),
  ms{to} AS (SELECT user_id, n, list_transform(list_transform(k, lambda x: {times("x", 3432918353)}), lambda x: {times(rot("x", 15), 461845907)}) AS k FROM mk{to}),
  mh{to} AS (SELECT user_id, n, k, list_reduce(list_prepend(0::bigint, k[:n // 4]), lambda h, x: ({rot("xor(h, x)", 13)} * 5 + 3864292196) & 4294967295) AS h FROM ms{to}),
  m0{to} AS (SELECT user_id, xor(CASE WHEN n % 4 > 0 THEN xor(h, k[n // 4 + 1]) ELSE h END, n) AS h FROM mh{to}),
  m1{to} AS (SELECT user_id, {times("xor(h, h >> 16)", 2246822507)} AS h FROM m0{to}), m2{to} AS (SELECT user_id, {times("xor(h, h >> 13)", 3266489909)} AS h FROM m1{to}), {to} AS (SELECT user_id, xor(h, h >> 16) AS h FROM m2{to})"""


_VARIANT_SQL = "CASE WHEN b > 7999 THEN NULL WHEN b / 8000.0 < 0.5 THEN 'control' WHEN b / 8000.0 < 0.8 THEN 't1' ELSE 't2' END"


@query(f"WITH {_murmur_views('rank-salt')} SELECT user_id, (h % 10000)::int AS bucket FROM hashed")
def as1_assign_buckets(spark, sf):
    users = V.metric_events(spark, sf).select("user_id").distinct()
    return S.assign_variants(users, EXPERIMENTS[1]).select("user_id", "bucket")


@query(f"WITH {_murmur_views('rank-salt')} SELECT {_VARIANT_SQL} AS variant_id, count(*) AS users FROM (SELECT h % 10000 AS b FROM hashed) GROUP BY 1")
def as2_assign_variants(spark, sf):
    users = V.metric_events(spark, sf).select("user_id").distinct()
    return S.assign_variants(users, EXPERIMENTS[1]).groupBy("variant_id").agg(F.count("*").alias("users"))


@query(f"WITH {_murmur_views('rank-salt', "SELECT DISTINCT user_id || '-' || session_no AS user_id FROM sessions")} SELECT {_VARIANT_SQL} AS variant_id, count(*) AS sessions FROM (SELECT h % 10000 AS b FROM hashed) GROUP BY 1")
def as3_session_assignment(spark, sf):
    s = V.sessions(spark, sf).select("user_id", F.concat_ws("-", "user_id", "session_no").alias("session_id")).distinct()
    return S.assign_variants(s, EXPERIMENTS[1], unit=S.session_unit(True)).groupBy("variant_id").agg(F.count("*").alias("sessions"))


def _assigned(spark, sf):
    users = V.metric_events(spark, sf).select("user_id").distinct().withColumn("attributes", F.create_map(F.lit("platform"), (F.col("user_id") % 4).cast("string")))
    return S.assign_all(users, EXPERIMENTS, F.col("attributes"))


_ALL_SQL = f"""WITH {_murmur_views('hold-salt', to='h1')}, {_murmur_views('rank-salt', to='h2')}, {_murmur_views('art-salt', to='h3')},
  held AS (SELECT user_id, 'hold' AS experiment_id, 'home' AS layer, 'holdout' AS variant_id FROM h1 WHERE h % 10000 <= 499),
  ranked AS (SELECT user_id, 'rank' AS experiment_id, 'home' AS layer, {_VARIANT_SQL} AS variant_id FROM (SELECT user_id, h % 10000 AS b FROM h2)),
  art AS (SELECT user_id, 'art' AS experiment_id, 'art' AS layer, CASE WHEN (h % 10000 - 2000) / 8000.0 < 0.5 THEN 'control' ELSE 't1' END AS variant_id FROM h3 WHERE h % 10000 >= 2000 AND user_id % 4 < 3),
  assigned AS (SELECT * FROM held UNION ALL SELECT * FROM ranked WHERE variant_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM held) UNION ALL SELECT * FROM art)"""


@query("SELECT user_id, (user_id % 4 < 3 OR content_id % 2 = 0) AND user_id % 5 = 0 AS eligible, count(*) AS n FROM metric_events GROUP BY 1, 2")
def as4_eligibility(spark, sf):
    rules = [[("platform", "IN", ["0", "1", "2"]), ("even", "EQUALS", ["yes"])], [("fifth", "EQUALS", ["0"])]]
    attributes = F.create_map(F.lit("platform"), (F.col("user_id") % 4).cast("string"), F.lit("even"), F.when(F.col("content_id") % 2 == 0, "yes").otherwise("no"), F.lit("fifth"), (F.col("user_id") % 5).cast("string"))
    return V.metric_events(spark, sf).select("user_id", targeting(attributes, rules).alias("eligible")).groupBy("user_id", "eligible").agg(F.count("*").alias("n"))


@query(f"{_ALL_SQL} SELECT user_id, experiment_id, layer, variant_id FROM assigned")
def as5_assign_all(spark, sf):
    return _assigned(spark, sf)


@query(f"{_ALL_SQL} SELECT experiment_id, count(*) AS exposures, count(*) FILTER (user_id % 10 = 0) AS mismatches FROM assigned GROUP BY 1")
def as6_parity_audit(spark, sf):
    logged = _assigned(spark, sf).withColumn("variant_id", F.when(F.col("user_id") % 10 == 0, "other").otherwise(F.col("variant_id")))
    return S.parity_audit(_assigned(spark, sf), logged)


@query("SELECT 'exp' AS experiment_id, (content_id % 4)::int AS arm_id, (1 + count(*) FILTER (value > 20))::double AS alpha, (1 + count(*) FILTER (value <= 20))::double AS beta, count(*) AS pulls FROM metric_events WHERE event_type IN ('click', 'purchase') GROUP BY 2")
def b1_thompson_posteriors(spark, sf):
    return B.thompson_posteriors(V.reward_events(spark, sf))


_CTX = "ctx AS (SELECT (content_id % 4)::int AS arm_id, CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END AS r, [1.0::double, content_id / 100.0, (value > 50)::int::double] AS x FROM metric_events WHERE event_type IN ('click', 'purchase'))"


@query(f"WITH {_CTX} SELECT 'exp' AS experiment_id, arm_id, p::int AS i, q::int AS j, round(sum(x[p + 1] * x[q + 1]) + any_value((p = q)::int), 6) AS a, round(sum(r * x[p + 1]) FILTER (p = q), 6) AS b FROM ctx, range(0, 3) a(p), range(0, 3) c(q) GROUP BY arm_id, p, q")
def b2_linucb_sums(spark, sf):
    return rounded(B.linucb_sums(V.reward_events(spark, sf)))


_UCB = _CTX.replace("AS x FROM metric_events", "AS x, event_id, user_id % 6 AS segment FROM metric_events") + """, m AS (SELECT arm_id, 1 + sum(x[1] * x[1]) AS a, sum(x[1] * x[2]) AS b, sum(x[1] * x[3]) AS c, 1 + sum(x[2] * x[2]) AS d, sum(x[2] * x[3]) AS e, 1 + sum(x[3] * x[3]) AS f, sum(r * x[1]) AS u, sum(r * x[2]) AS v, sum(r * x[3]) AS w FROM ctx GROUP BY 1),
  g AS (SELECT *, d * f - e * e AS i11, c * e - b * f AS i12, b * e - c * d AS i13, a * f - c * c AS i22, b * c - a * e AS i23, a * d - b * b AS i33, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM m),
  th AS (SELECT *, (i11 * u + i12 * v + i13 * w) / det AS t1, (i12 * u + i22 * v + i23 * w) / det AS t2, (i13 * u + i23 * v + i33 * w) / det AS t3 FROM g),
  sc AS (SELECT c.event_id, c.segment, th.arm_id, t1 * x[1] + t2 * x[2] + t3 * x[3] AS mean, (i11 * x[1] * x[1] + i22 * x[2] * x[2] + i33 * x[3] * x[3] + 2 * (i12 * x[1] * x[2] + i13 * x[1] * x[3] + i23 * x[2] * x[3])) / det AS var FROM ctx c, th)"""


@query(f"WITH {_UCB} SELECT event_id, arm_id, round(mean + sqrt(greatest(0, var)), 6) AS score FROM sc")
def b3_ucb_scores(spark, sf):
    r = V.reward_events(spark, sf)
    return rounded(B.ucb_scores(r.select("experiment_id", "event_id", "context"), B.linucb_weights(B.linucb_sums(r))).select("event_id", "arm_id", "score"))


@query()
def b4_selection_probabilities(spark, sf):
    return B.selection_probabilities(B.thompson_posteriors(V.reward_events(spark, sf)))


@query(f"WITH {_UCB}, k AS (SELECT segment, arm_id, avg(mean) AS score FROM sc GROUP BY 1, 2) SELECT segment, arg_max(arm_id, score) AS arm_id, round(max(score), 6) AS score FROM k GROUP BY 1")
def b5_best_arm_per_segment(spark, sf):
    r = V.reward_events(spark, sf)
    contexts = r.select("experiment_id", (F.col("user_id") % 6).alias("segment"), "context")
    return rounded(B.best_arm(B.ucb_scores(contexts, B.linucb_weights(B.linucb_sums(r)), alpha=0.0), ["segment"]))


def _slates(spark, sf):
    r = V.reward_events(spark, sf)
    return r.select(F.col("event_id").alias("slate_id"), F.array(*[F.lit(i) for i in range(5)]).alias("items"), F.when(F.col("user_id") % 3 > 0, F.col("position")).alias("clicked"), "reward")


@query("""WITH s AS (SELECT event_id, CASE WHEN user_id % 3 > 0 THEN content_id % 5 END AS c, CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END AS r FROM metric_events WHERE event_type IN ('click', 'purchase')), p AS (SELECT *, p::int AS position, CASE WHEN p = c THEN r ELSE 0 END AS hit FROM s, range(0, 5) t(p))
  SELECT scheme, event_id AS slate_id, position, round(CASE scheme WHEN 'position_weighted' THEN hit / (position + 1) ELSE hit END, 6)::double AS reward FROM p, (VALUES ('leave_one_out'), ('clicked_only'), ('position_weighted')) v(scheme) WHERE scheme <> 'leave_one_out' OR c IS NULL OR position <= c""")
def b6_slate_rewards(spark, sf):
    each = [B.slate_rewards(_slates(spark, sf), s).select(F.lit(s).alias("scheme"), "slate_id", "position", "reward") for s in ("leave_one_out", "clicked_only", "position_weighted")]
    return rounded(each[0].unionByName(each[1]).unionByName(each[2]))


@query("SELECT event_id, round(greatest(0, least(1, r * 0.5 / pow(0.85, p))), 6) AS cascade, round(greatest(0, least(1, r * 0.5 / CASE p WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 ELSE 1.0 END)), 6) AS examination, round(r * 0.5, 6) AS plain FROM (SELECT event_id, CASE WHEN value > 20 THEN 1.0::double ELSE 0.0 END AS r, content_id % 5 AS p FROM metric_events WHERE event_type IN ('click', 'purchase'))")
def b7_position_bias(spark, sf):
    half, at = F.col("reward") * 0.5, F.col("position")
    seen = {0: 1.0, 1: 0.7, 2: 0.4}
    return rounded(V.reward_events(spark, sf).select("event_id", B.debiased(half, at, "cascade").alias("cascade"), B.debiased(half, at, "examination", examination=seen).alias("examination"), B.debiased(half, at).alias("plain")))


@query("SELECT 'exp' AS experiment_id, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END / (0.05 + 0.01 * (content_id % 5))), 6) AS value, count(*) AS n FROM metric_events WHERE event_type IN ('click', 'purchase')")
def b8_lips_estimate(spark, sf):
    return rounded(B.lips_estimate(V.reward_events(spark, sf), ["experiment_id"]))


@query("""WITH e AS (SELECT CASE WHEN value > 20 THEN 1.0::double ELSE 0.0 END AS r, row_number() OVER (ORDER BY event_id DESC) - 1 AS back, count(*) OVER () AS n FROM metric_events WHERE event_type IN ('click', 'purchase')),
  s AS (SELECT sum(0.01 * pow(0.99, back) * r) AS m, sum(0.01 * pow(0.99, back) * r * r) + pow(0.99, any_value(n)) AS q, max(r) FILTER (back = 0) AS last FROM e)
  SELECT 'exp' AS experiment_id, round(m, 6) AS mean, round(q - m * m, 6) AS variance, round((last - m) / sqrt(q - m * m), 6) AS z FROM s""")
def b9_reward_normalisation(spark, sf):
    # tests hold the weighted sums against the step-by-step recursion
    return rounded(B.ema_normalised(V.reward_events(spark, sf), ["experiment_id"], "event_id"))


@query("""WITH z AS (SELECT event_id, CASE WHEN value > 20 THEN 1.0::double ELSE 0.0 END - 0.5 AS a, content_id / 100.0 - 0.5 AS b FROM metric_events WHERE event_type IN ('click', 'purchase'))
  SELECT event_id, round(0.7 * a + 0.3 * b, 6) AS weighted, round(0.7 * a + 0.3 * b - 10 * greatest(0, 0.1 - b), 6) AS constrained, round(-greatest(0.7 * abs(0.5 - a), 0.3 * abs(0.5 - b), 0), 6) AS tchebycheff FROM z""")
def b9_composed_rewards(spark, sf):
    z = {"reward": F.col("reward") - 0.5, "place": F.element_at("context", 2) - 0.5}
    weights = {"reward": 0.7, "place": 0.3}
    half = {m: F.lit(0.5) for m in z}
    return rounded(V.reward_events(spark, sf).select("event_id", B.composed(z, "weighted", weights).alias("weighted"), B.composed(z, "epsilon_constraint", weights, floors={"place": 0.1}).alias("constrained"), B.composed(z, "tchebycheff", weights, half).alias("tchebycheff")))


@query("""WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k, CASE WHEN value > 20 THEN 1.0::double ELSE 0.0 END AS a, content_id / 100.0::double AS b FROM metric_events WHERE event_type IN ('click', 'purchase')),
  c AS (SELECT l.event_id, l.k, any_value(l.a) AS a, any_value(l.b) AS b, sum(0.01 * pow(0.99, l.k - e.k) * e.a) AS ma, pow(0.99, l.k) + sum(0.01 * pow(0.99, l.k - e.k) * e.a * e.a) AS qa, sum(0.01 * pow(0.99, l.k - e.k) * e.b) AS mb, pow(0.99, l.k) + sum(0.01 * pow(0.99, l.k - e.k) * e.b * e.b) AS qb FROM r l JOIN r e ON e.k BETWEEN l.k - 4000 AND l.k GROUP BY 1, 2),
  z AS (SELECT event_id, k, (a - ma) / sqrt(greatest(qa - ma * ma, 1e-8)) AS za, (b - mb) / sqrt(greatest(qb - mb * mb, 1e-8)) AS zb FROM c),
  i AS (SELECT *, greatest(0, max(za) OVER (ORDER BY k)) AS ia, greatest(0, max(zb) OVER (ORDER BY k)) AS ib FROM z)
  SELECT event_id, round(za, 5) AS z_reward, round(ia, 5) AS ideal_reward, round(ib, 5) AS ideal_place, round(-greatest(0.7 * abs(ia - za), 0.3 * abs(ib - zb), 0), 5) + 0.0 AS tchebycheff FROM i""")
def b9_ideal_points(spark, sf):
    """Rewards and places against the best of each so far, as moving averages normalise them."""
    one = lambda name, value: F.struct(F.lit(name).alias("metric"), F.coalesce(value, F.lit(0.0)).alias("reward"))
    rows = V.reward_events(spark, sf).select("event_id", F.inline(F.array(one("reward", F.col("reward")), one("place", F.element_at("context", 2)))))
    path = B.ema_path(rows, ["metric"], "event_id")
    pivoted = path.groupBy("event_id").agg(*[F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{c}_{m}") for m in ("reward", "place") for c in ("z", "ideal")])
    z, ideal = ({m: F.col(f"{c}_{m}") for m in ("reward", "place")} for c in ("z", "ideal"))
    return rounded(pivoted.select("event_id", "z_reward", "ideal_reward", "ideal_place", B.composed(z, "tchebycheff", {"reward": 0.7, "place": 0.3}, ideal).alias("tchebycheff")), 5)


@query("WITH r AS (SELECT event_id, (content_id % 4)::int AS arm, CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END - 0.5 AS y FROM metric_events WHERE event_type IN ('click', 'purchase') AND user_id % 2 = 0), b AS (SELECT arm, y, coalesce(avg(y) OVER (PARTITION BY arm ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 0.25 AS l FROM r) SELECT arm AS arm_id, round(sum(l * y - 0.5 * l * l * 0.25), 6) AS log_e, count(*) AS n FROM b GROUP BY 1")
def b10_mad_e_process(spark, sf):
    r = V.reward_events(spark, sf).select("arm_id", "event_id", (F.col("reward") - 0.5).alias("y"), (F.col("user_id") % 2 == 0).alias("uniform"))
    return rounded(B.mad_e_process(r, ["arm_id"], ["event_id"], 0.25).select("arm_id", "log_e", "n"))


@query("SELECT experiment_id, d AS event_date, arm_id, n, round(n / sum(n) OVER (PARTITION BY d), 6) AS share FROM (SELECT 'exp' AS experiment_id, event_date::varchar AS d, (content_id % 4)::int AS arm_id, count(*) AS n FROM metric_events WHERE event_type IN ('click', 'purchase') GROUP BY 2, 3)")
def b11_daily_allocation(spark, sf):
    r = V.reward_events(spark, sf).withColumn("event_date", F.to_date("event_timestamp").cast("string"))
    return rounded(B.daily_shares(r, "event_date"))


@query("""WITH e AS (SELECT (content_id % 4)::int AS arm, row_number() OVER (ORDER BY event_id DESC) - 1 AS back, count(*) OVER () AS n FROM metric_events WHERE event_type IN ('click', 'purchase')), s AS (SELECT a::int AS arm_id, pow(0.95, any_value(n)) / 4 + sum(CASE WHEN arm = a THEN 0.05 * pow(0.95, back) ELSE 0 END) AS share FROM e, range(0, 4) t(a) GROUP BY a)
  SELECT 'exp' AS experiment_id, arm_id, round(share, 6) AS share, share BETWEEN 0.05 AND 0.6 AS in_bounds FROM s""")
def b11_allocation_ema(spark, sf):
    return rounded(B.allocation_shares(V.reward_events(spark, sf), "event_id", 0.05, [0, 1, 2, 3], 0.05, 0.6))


def _rankings(spark, sf):
    n = F.row_number
    from pyspark.sql import Window

    counts = V.metric_events(spark, sf).groupBy("user_id", F.col("content_id").alias("item")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    own = lambda c: Window.partitionBy("user_id").orderBy(F.desc(c), "item")
    one = counts.select("user_id", F.lit("algo_a").alias("algorithm"), n().over(own("n")).alias("rank"), "item")
    two = counts.select("user_id", F.lit("algo_b").alias("algorithm"), n().over(own("v")).alias("rank"), "item")
    return one.unionByName(two).filter("rank <= 10")


@query()
def il1_team_draft(spark, sf):
    return B.interleave(_rankings(spark, sf))


@query()
def il2_optimized(spark, sf):
    return B.interleave(_rankings(spark, sf), "optimized")


@query()
def il3_multileave(spark, sf):
    r = _rankings(spark, sf)
    third = r.filter("algorithm = 'algo_a'").withColumn("algorithm", F.lit("algo_c")).withColumn("rank", 11 - F.col("rank"))
    return B.interleave(r.unionByName(third), "multileave")

