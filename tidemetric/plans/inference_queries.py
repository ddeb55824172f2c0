"""Inference queries over user-day summaries. P-values need distribution functions, which
DuckDB lacks: queries with a twin return the statistics, tests hold p-values against
golden values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemetric.operators import inference as I
from tidemetric.plans.registry import half_normal_sql, normal_cdf_sql, query, rounded, t_two_sided_sql
from tidemetric.sources import views as V

KEYS = ["metric_id"]


def observations(spark, sf):
    s = V.metric_summaries(spark, sf)
    return s.select("metric_id", "variant_id", "user_id", "lifecycle_segment", "computation_date", F.col("metric_value").alias("y"), F.col("cuped_covariate").alias("x"), F.col("assignment_probability").alias("p"))


def _pairs(spark, sf, covariate=False, keys=KEYS):
    return I.arm_pairs(I.moments(observations(spark, sf), keys, covariate), keys)


_OBS = "obs AS (SELECT 'value' AS metric_id, variant_id, user_id, lifecycle_segment, computation_date, metric_value AS y, cuped_covariate AS x, assignment_probability AS p FROM summaries)"
_ARMS = _OBS + ", arms AS (SELECT metric_id, variant_id, count(*) AS n, avg(y) AS m, var_samp(y) AS v, avg(x) AS mx, var_samp(x) AS vx, covar_samp(x, y) AS cv FROM obs GROUP BY 1, 2)"
_PAIRS = _ARMS + """, pairs AS (SELECT t.metric_id, t.variant_id, t.n AS nt, c.n AS nc, t.m AS mt, c.m AS mc, t.v AS vt, c.v AS vc, t.mx AS mxt, c.mx AS mxc, t.vx AS vxt, c.vx AS vxc, t.cv AS ct, c.cv AS cc
  FROM arms t JOIN arms c USING (metric_id) WHERE t.variant_id <> 'control' AND c.variant_id = 'control'),
  welch AS (SELECT *, mt - mc AS effect, sqrt(vt / nt + vc / nc) AS se, pow(vt / nt + vc / nc, 2) / (pow(vt / nt, 2) / (nt - 1) + pow(vc / nc, 2) / (nc - 1)) AS df FROM pairs),
  theta AS (SELECT *, ((nt - 1) * ct + (nc - 1) * cc + nt * nc / (nt + nc) * (mt - mc) * (mxt - mxc)) AS sxy, ((nt - 1) * vxt + (nc - 1) * vxc + nt * nc / (nt + nc) * pow(mxt - mxc, 2)) AS sxx, ((nt - 1) * vt + (nc - 1) * vc + nt * nc / (nt + nc) * pow(mt - mc, 2)) AS syy FROM pairs),
  adj AS (SELECT *, sxy / sxx AS th, vt - 2 * sxy / sxx * ct + pow(sxy / sxx, 2) * vxt AS a_t, vc - 2 * sxy / sxx * cc + pow(sxy / sxx, 2) * vxc AS a_c FROM theta),
  cup AS (SELECT *, mt - mc AS raw_effect, mt - mc - th * (mxt - mxc) AS effect, sqrt(a_t / nt + a_c / nc) AS se, 1 - (a_t / nt + a_c / nc) / (vt / nt + vc / nc) AS variance_reduction, 2.0 * nt * nc / (nt + nc) AS n_eff FROM adj)"""
Z975 = 1.959963984540054


@query(f"WITH {_PAIRS} SELECT variant_id, round(effect, 6) AS effect, round(se, 6) AS se, round(df, 4) AS df, round(effect / se, 6) AS t FROM welch")
def a1_welch(spark, sf):
    return rounded(I.welch(_pairs(spark, sf)).select("variant_id", "effect", "se", F.round("df", 4).alias("df"), "t"))


_T975 = " + ".join(f"{c / d!r} / pow(df, {k})" for k, (c, d) in enumerate([(Z975, 1), (Z975**3 + Z975, 4), (5 * Z975**5 + 16 * Z975**3 + 3 * Z975, 96), (3 * Z975**7 + 19 * Z975**5 + 17 * Z975**3 - 15 * Z975, 384), (79 * Z975**9 + 776 * Z975**7 + 1482 * Z975**5 - 1920 * Z975**3 - 945 * Z975, 92160)]))


@query(f"WITH {_PAIRS}, p AS (SELECT *, {t_two_sided_sql('(effect / se)', 'df')} AS p FROM welch) SELECT variant_id, round(effect, 6) AS effect, round(p, 6) AS p_value, round(effect - ({_T975}) * se, 5) AS ci_lower, round(effect + ({_T975}) * se, 5) AS ci_upper, p < 0.05 AS significant FROM p")
def a1_welch_p_values(spark, sf):
    # the twin's quantile is its expansion in 1 / df, good to 1e-8 from 30 degrees of freedom on
    out = I.with_t_test(I.welch(_pairs(spark, sf)))
    return rounded(out.select("variant_id", "effect", "p_value", F.round("ci_lower", 5).alias("ci_lower"), F.round("ci_upper", 5).alias("ci_upper"), "significant"))


@query("WITH s AS (SELECT experiment_id, sum(pow(u - tot * share, 2) / (tot * share)) AS chi_square, count(*) - 1 AS df, sum(u)::bigint AS users FROM (SELECT experiment_id, variant_id, CASE variant_id WHEN 'control' THEN 0.4 ELSE 0.3 END AS share, count(DISTINCT user_id) AS u, sum(count(DISTINCT user_id)) OVER (PARTITION BY experiment_id) AS tot FROM exposures GROUP BY 1, 2) GROUP BY 1) SELECT experiment_id, round(chi_square, 6) AS chi_square, df, users, round(exp(-chi_square / 2), 6) AS p_value, exp(-chi_square / 2) < 0.001 AS mismatch FROM s")
def a2_srm_check(spark, sf):
    # three arms have two degrees of freedom, where the tail of χ² is exp(-x / 2)
    return rounded(I.with_srm_p(I.srm_check(V.exposures(spark, sf), ["experiment_id"], {"control": 0.4, "t1": 0.3, "t2": 0.3})))


@query(f"WITH {_PAIRS} SELECT variant_id, round(th, 6) AS theta, round(raw_effect, 6) AS raw_effect, round(effect, 6) AS effect, round(se, 6) AS se, round(variance_reduction, 6) AS variance_reduction, round(effect - {Z975} * se, 6) AS ci_lower, round(effect + {Z975} * se, 6) AS ci_upper FROM cup")
def a3_cuped(spark, sf):
    return rounded(I.cuped(_pairs(spark, sf, True)).select("variant_id", "theta", "raw_effect", "effect", "se", "variance_reduction", "ci_lower", "ci_upper"))


@query(f"WITH {_PAIRS}, h AS (SELECT *, se * sqrt(2 * (se * se * n_eff / 0.5 + n_eff) / n_eff * (ln(1 / 0.05) + 0.5 * ln(1 + n_eff / (se * se * n_eff / 0.5)))) AS half FROM cup) SELECT variant_id, round(effect, 6) AS effect, round(half, 6) AS half_width, round(effect - half, 6) AS ci_lower, round(effect + half, 6) AS ci_upper, abs(effect) > half AS significant FROM h")
def a4_avlm(spark, sf):
    return rounded(I.avlm(_pairs(spark, sf, True), 0.5).select("variant_id", "effect", "half_width", "ci_lower", "ci_upper", "significant"))


@query(f"WITH {_PAIRS}, l AS (SELECT *, 0.5 * ln(v / (v + n)) + n * pow(effect / se, 2) / (2 * (v + n)) AS log_lambda FROM (SELECT *, (vt + vc) / 2 / 0.5 AS v, 2.0 * nt * nc / (nt + nc) AS n FROM welch)) SELECT variant_id, round(log_lambda, 6) AS log_lambda, round(least(1, exp(-log_lambda)), 6) AS always_valid_p, log_lambda > ln(20) AS crossed FROM l")
def a5_msprt(spark, sf):
    return rounded(I.msprt(_pairs(spark, sf), 0.5).select("variant_id", "log_lambda", "always_valid_p", "crossed"))


@query(f"""WITH {_OBS}, daily AS (SELECT variant_id, computation_date, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM obs GROUP BY 1, 2),
  run AS (SELECT variant_id, computation_date, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(ss) OVER w AS ss FROM daily WINDOW w AS (PARTITION BY variant_id ORDER BY computation_date)),
  ms AS (SELECT *, s / n AS m, (ss - s * s / n) / (n - 1) AS v FROM run),
  z AS (SELECT t.variant_id, t.computation_date, (t.m - c.m) / sqrt(t.v / t.n + c.v / c.n) AS z, row_number() OVER (PARTITION BY t.variant_id ORDER BY t.computation_date)::int AS look FROM ms t JOIN ms c USING (computation_date) WHERE t.variant_id <> 'control' AND c.variant_id = 'control')
  SELECT variant_id, look, round(z, 5) AS z, abs(z) >= b AS crossed, round(0.05 * ln(1 + (2.718281828459045 - 1) * look / 4.0), 6) AS alpha_spent FROM z JOIN (VALUES (1, 2.361), (2, 2.361), (3, 2.361), (4, 2.361)) t(look, b) USING (look)""")
def a6_group_sequential(spark, sf):
    looks = I.look_statistics(observations(spark, sf), KEYS, "computation_date")
    out = I.group_sequential(looks, {k: 2.361 for k in (1, 2, 3, 4)})
    return rounded(out.select("variant_id", "look", F.round("t", 5).alias("z"), "crossed", "alpha_spent"))


@query(f"WITH {_OBS}, b AS (SELECT metric_id, variant_id, (y - 50) / 10 AS y, coalesce(avg((y - 50) / 10) OVER (PARTITION BY metric_id, variant_id ORDER BY computation_date, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 100 AS l FROM obs) SELECT variant_id, round(sum(l * y - 0.5 * l * l * 100), 6) AS log_e, count(*) AS n, sum(l * y - 0.5 * l * l * 100) > ln(20) AS reject FROM b GROUP BY 1")
def a7_e_value_grow(spark, sf):
    obs = observations(spark, sf).withColumn("y", (F.col("y") - 50) / 10)
    return rounded(I.e_value_grow(obs, ["metric_id", "variant_id"], ["computation_date", "user_id"], 100.0).select("variant_id", "log_e", "n", "reject"))


@query(f"WITH {_PAIRS}, s AS (SELECT *, greatest((syy - sxy * sxy / sxx) / (nt + nc - 1), syy / (nt + nc - 1) * 1e-12) * (1.0 / nt + 1.0 / nc) AS q FROM cup) SELECT variant_id, round(0.5 * ln(q / (q + 0.5)) + effect * effect * 0.5 / (2 * q * (q + 0.5)), 6) AS log_e FROM s")
def a8_e_value_adjusted(spark, sf):
    return rounded(I.e_value_adjusted(_pairs(spark, sf, True), 0.5).select("variant_id", "log_e"))


def _upper_p(t: str, df: str) -> str:
    return f"CASE WHEN {t} > 0 THEN {t_two_sided_sql(t, df)} / 2 ELSE 1 - {t_two_sided_sql(t, df)} / 2 END"


_TOST = _PAIRS + f", tt AS (SELECT variant_id, (effect + 0.1 * mc) / se AS tl, (0.1 * mc - effect) / se AS tu, df FROM welch), tost AS (SELECT *, greatest({_upper_p('tl', 'df')}, {_upper_p('tu', 'df')}) AS p FROM tt)"


@query(f"WITH {_TOST} SELECT variant_id, round(tl, 6) AS t_lower, round(tu, 6) AS t_upper, round(p, 6) AS p_value, p < 0.05 AS equivalent FROM tost")
def a9_tost(spark, sf):
    return rounded(I.with_tost_p(I.tost(I.welch(_pairs(spark, sf)), 0.1 * F.col("mean_c"))).select("variant_id", "t_lower", "t_upper", "p_value", "equivalent"))


@query(f"WITH {_PAIRS} SELECT variant_id, round((effect + 5) / se, 6) AS t_lower, round((5 - effect) / se, 6) AS t_upper FROM cup")
def a10_tost_cuped(spark, sf):
    return rounded(I.tost_cuped(_pairs(spark, sf, True), F.lit(5.0)).select("variant_id", "t_lower", "t_upper"))


@query(f"WITH {_PAIRS} SELECT variant_id, ceil(2 * (vt + vc) / 2 * pow(({I.z_quantile(0.95)!r} + {I.z_quantile(0.9)!r}) / 5, 2))::bigint AS n_per_arm, round(5 / sqrt(vt / nt + vc / nc) - {I.z_quantile(0.95)!r}, 6) AS z_now, round(greatest(0, 2 * {normal_cdf_sql(f"(5 / sqrt(vt / nt + vc / nc) - {I.z_quantile(0.95)!r})")} - 1), 6) AS power FROM pairs")
def a11_tost_sample_size(spark, sf):
    return rounded(I.with_tost_power(I.tost_sample_size(_pairs(spark, sf), 5.0)).select("variant_id", "n_per_arm", "z_now", "power"))


@query(f"""WITH {_OBS}, w AS (SELECT variant_id, y, 1 / least(greatest(p, 0.25), 0.75) AS w, (p < 0.25 OR p > 0.75) AS clip FROM obs),
  a AS (SELECT variant_id, sum(w) AS w, sum(w * y) / sum(w) AS m, sum(w * w) AS ww, sum(w * w * y) AS wwy, sum(w * w * y * y) AS wwyy, count(*) FILTER (clip) AS k FROM w GROUP BY 1),
  b AS (SELECT *, (wwyy - 2 * m * wwy + m * m * ww) / (w * w) AS v FROM a)
  SELECT t.variant_id, round(t.m - c.m, 6) AS effect, round(sqrt(t.v + c.v), 6) AS se, t.k + c.k AS clipped, round(pow(t.w + c.w, 2) / (t.ww + c.ww), 4) AS ess FROM b t, b c WHERE t.variant_id <> 'control' AND c.variant_id = 'control'""")
def a12_ipw(spark, sf):
    return rounded(I.ipw(observations(spark, sf), KEYS, 0.25).select("variant_id", "effect", "se", "clipped", F.round("ess", 4).alias("ess")))


@query(f"""WITH {_OBS}, m AS (SELECT variant_id, avg(y) AS m, count(*) AS n FROM obs GROUP BY 1),
  r AS (SELECT variant_id, user_id, sum(y - m) AS s, sum(pow(y - m, 2)) AS q FROM obs JOIN m USING (variant_id) GROUP BY 1, 2),
  a AS (SELECT variant_id, sum(s * s) AS meat, sum(q) AS rss, count(*) AS g FROM r GROUP BY 1)
  SELECT t.variant_id, round(mt.m - mc.m, 6) AS effect, round(sqrt((t.rss + c.rss) / (mt.n + mc.n - 2) * (1.0 / mt.n + 1.0 / mc.n)), 5) AS naive_se,
  round(sqrt((t.meat / pow(mt.n, 2) + c.meat / pow(mc.n, 2)) * (t.g + c.g) / (t.g + c.g - 1.0) * (mt.n + mc.n) / (mt.n + mc.n - 2.0)), 5) AS se, t.g + c.g AS clusters
  FROM a t JOIN m mt USING (variant_id), a c JOIN m mc USING (variant_id) WHERE t.variant_id <> 'control' AND c.variant_id = 'control'""")
def a13_clustered_se(spark, sf):
    return rounded(I.clustered(observations(spark, sf), KEYS, "user_id").select("variant_id", "effect", F.round("naive_se", 5).alias("naive_se"), F.round("se", 5).alias("se"), "clusters"))


_SEG = _OBS + """, arms AS (SELECT variant_id, lifecycle_segment AS g, count(*) AS n, avg(y) AS m, var_samp(y) AS v FROM obs GROUP BY 1, 2),
  seg AS (SELECT t.variant_id, g, t.m - c.m AS effect, sqrt(t.v / t.n + c.v / c.n) AS se FROM (SELECT * FROM arms WHERE variant_id <> 'control') t JOIN (SELECT * FROM arms WHERE variant_id = 'control') c USING (g) WHERE t.n >= 2 AND c.n >= 2)"""


def _segments(spark, sf):
    # segments follow the user id as arms do, so each arm is cut by a hash of the day as well
    obs = observations(spark, sf).withColumn("lifecycle_segment", F.concat(F.lit("d"), (F.dayofmonth("computation_date") % 4).cast("string")))
    return I.welch(I.arm_pairs(I.moments(obs, ["lifecycle_segment"]), ["lifecycle_segment"]))


_SEG = _SEG.replace("lifecycle_segment AS g", "'d' || (day(computation_date) % 4) AS g")


@query(f"WITH {_SEG} SELECT variant_id, g AS lifecycle_segment, round(effect, 6) AS effect, round(se, 6) AS se FROM seg")
def a14_cate_by_segment(spark, sf):
    return rounded(_segments(spark, sf).select("variant_id", "lifecycle_segment", "effect", "se"))


@query(f"WITH {_SEG}, s AS (SELECT variant_id, count(*) AS k, sum(1 / (se * se)) AS w, sum(effect / (se * se)) AS we, sum(effect * effect / (se * se)) AS wee FROM seg GROUP BY 1), q AS (SELECT *, greatest(0, wee - we * we / w) AS q FROM s) SELECT variant_id, k, round(q, 6) AS q, (k - 1)::double AS df, round(1 - 2 * {half_normal_sql('sqrt(q)')} + sqrt(2 * q / pi()) * exp(-q / 2), 6) AS p_value, round(greatest(0, (q - (k - 1)) / q) * 100, 6) AS i_squared, round(we / w, 6) AS pooled_effect FROM q")
def a15_cochran_q(spark, sf):
    return rounded(I.cochran_q(_segments(spark, sf), ["variant_id"]))


_TESTS = _SEG + ", tests AS (SELECT variant_id || '/' || g AS variant_id, 'value' AS metric_id, round(exp(-pow(effect / se, 2) / 2), 9) AS p_value FROM seg)"


def _tests(spark, sf):
    # a closed-form bound on p, so that both engines have the same p-values
    z = F.col("t")
    return _segments(spark, sf).select(F.concat_ws("/", "variant_id", "lifecycle_segment").alias("variant_id"), F.lit("value").alias("metric_id"), F.round(F.exp(-z * z / 2), 9).alias("p_value"))


@query(f"WITH {_TESTS} SELECT variant_id, round(least(1, p_value * (SELECT count(*) FROM tests)), 6) AS p_adjusted, p_value <= 0.2 / (SELECT count(*) FROM tests) AS reject FROM tests")
def a16_bonferroni(spark, sf):
    return rounded(I.bonferroni(_tests(spark, sf), KEYS, 0.2).select("variant_id", "p_adjusted", "reject"))


@query(f"WITH {_TESTS}, r AS (SELECT *, row_number() OVER (ORDER BY p_value, variant_id) AS k, count(*) OVER () AS n FROM tests), a AS (SELECT variant_id, least(1, min(p_value * n / k) OVER (ORDER BY p_value, variant_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS a FROM r) SELECT variant_id, round(a, 6) AS p_adjusted, a <= 0.6 AS reject FROM a")
def a17_benjamini_hochberg(spark, sf):
    return rounded(I.benjamini_hochberg(_tests(spark, sf), KEYS, 0.6).select("variant_id", "p_adjusted", "reject"))


@query("""WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY user_id) AS k, user_id, CASE WHEN user_id % 9 = 0 THEN 4000.0 ELSE 0.5 END AS e FROM (SELECT DISTINCT user_id FROM metric_events)),
  f(k, wealth, hits) AS (SELECT 0::bigint, 0.05::double, 0 UNION ALL SELECT f.k + 1,
    greatest(0, wealth - wealth * 0.1 * pow(0.9, f.k) + CASE WHEN e.e * wealth * 0.1 * pow(0.9, f.k) >= 1 THEN 0.05 ELSE 0 END), hits + CASE WHEN e.e * wealth * 0.1 * pow(0.9, f.k) >= 1 THEN 1 ELSE 0 END
    FROM f JOIN e ON e.k = f.k + 1)
  SELECT k::int AS tests, hits AS rejections, round(wealth, 9) AS wealth FROM f WHERE k = (SELECT max(k) FROM e)""")
def a18_online_fdr(spark, sf):
    users = V.metric_events(spark, sf).select("user_id").distinct()
    tests = users.select(F.lit("program").alias("program"), "user_id", F.when(F.col("user_id") % 9 == 0, 4000.0).otherwise(0.5).alias("e_value"))
    return rounded(I.online_fdr(tests, ["program"], "user_id", 0.05, 0.9).drop("program"), 9)


@query(f"WITH {_PAIRS} SELECT variant_id, round((effect / (se * se)) / (1 / (se * se) + 1 / 4.0), 6) AS posterior_mean, round(sqrt(1 / (1 / (se * se) + 1 / 4.0)), 6) AS posterior_sd FROM welch")
def a20_bayes_normal(spark, sf):
    return rounded(I.bayes_normal(_pairs(spark, sf), 0.0, 4.0).select("variant_id", "posterior_mean", "posterior_sd"))


_Z_EXTRA = I.z_quantile(0.975) + I.z_quantile(0.9)


@query(f"""WITH {_OBS}, b AS (SELECT metric_id, var_samp(y) AS v, count(*) / 3.0 AS n FROM obs GROUP BY 1), c AS (SELECT *, 3 * sqrt(n / 2) / sqrt(v) AS now, 3 * sqrt(2000 / 2) / sqrt(v) AS planned FROM b),
  p AS (SELECT *, {normal_cdf_sql(f"(planned - {Z975})")} + {normal_cdf_sql(f"(-planned - {Z975})")} AS power FROM c), z AS (SELECT *, CASE WHEN power >= 0.9 THEN 'favorable' WHEN power >= 0.3 THEN 'promising' ELSE 'futile' END AS zone FROM p)
  SELECT metric_id, round(v, 4) AS blinded_var, round(now, 6) AS ncp_now, round(planned, 6) AS ncp_planned, round(power, 6) AS power, zone, (CASE WHEN zone = 'promising' THEN least(ceil(2 * v * pow({_Z_EXTRA!r} / 3, 2)), 4000) ELSE 2000 END)::bigint AS extended_n FROM z""")
def a23_adaptive_sample_size(spark, sf):
    out = I.with_conditional_power(I.adaptive_sample_size(observations(spark, sf), KEYS, 3.0, 2000), 3.0, planned=2000)
    return rounded(out.select("metric_id", F.round("blinded_var", 4).alias("blinded_var"), "ncp_now", "ncp_planned", "power", "zone", "extended_n"))


_SRM = "srm AS (SELECT exp(-sum(pow(u - tot / 3.0, 2) / (tot / 3.0)) / 2) AS p FROM (SELECT count(DISTINCT user_id) AS u, sum(count(DISTINCT user_id)) OVER () AS tot FROM summaries GROUP BY variant_id))"
_SEG_Q = _SEG.split("arms AS", 1)[1].replace("arms", "sarms")


@query(f"""WITH {_TOST}, {_SRM}, sarms AS{_SEG_Q}, sq AS (SELECT variant_id, count(*) AS k, sum(1 / (se * se)) AS w, sum(effect / (se * se)) AS we, sum(effect * effect / (se * se)) AS wee FROM seg GROUP BY 1),
  gl AS (SELECT variant_id, y - (SELECT avg(y) FROM obs WHERE variant_id = 'control') AS y, computation_date, user_id FROM obs WHERE variant_id <> 'control'), gb AS (SELECT *, coalesce(avg(y) OVER (PARTITION BY variant_id ORDER BY computation_date, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000 AS l FROM gl), gr AS (SELECT variant_id, sum(l * y - 0.5 * l * l * 1000) AS g FROM gb GROUP BY 1),
  le AS (SELECT variant_id, 0.5 * ln(q / (q + 0.5)) + effect * effect * 0.5 / (2 * q * (q + 0.5)) AS log_e FROM (SELECT *, greatest((syy - sxy * sxy / sxx) / (nt + nc - 1), syy / (nt + nc - 1) * 1e-12) * (1.0 / nt + 1.0 / nc) AS q FROM cup))
  SELECT c.variant_id, round(c.raw_effect, 6) AS effect, round(w.se, 6) AS se, round({t_two_sided_sql('(w.effect / w.se)', 'w.df')}, 6) AS p_value, round(c.effect, 6) AS adjusted_effect, round(c.se, 6) AS adjusted_se, round(c.variance_reduction, 6) AS variance_reduction, c.nt::bigint AS n_treatment, c.nc::bigint AS n_control,
  round(le.log_e, 6) AS log_e, round(tost.p, 6) AS tost_p, sq.k AS segments, round(greatest(0, wee - we * we / w), 6) AS q, round(1 - 2 * {half_normal_sql('sqrt(greatest(0, wee - we * we / w))')} + sqrt(2 * greatest(0, wee - we * we / w) / pi()) * exp(-greatest(0, wee - we * we / w) / 2), 6) AS q_p, round(gr.g, 6) AS grow_log_e, gr.g > ln(20) AS grow_reject, round(srm.p, 6) AS srm_p
  FROM cup c JOIN gr USING (variant_id) JOIN (SELECT variant_id, effect, se, df FROM welch) w USING (variant_id) JOIN le USING (variant_id) JOIN tost USING (variant_id) JOIN sq USING (variant_id), srm""".replace("we * we / w)", "we * we / sq.w)"))
def a47_analysis_report(spark, sf):
    from tidemetric.plans.report import analysis_report

    obs = observations(spark, sf).withColumn("lifecycle_segment", F.concat(F.lit("d"), (F.dayofmonth("computation_date") % 4).cast("string")))
    out = analysis_report(obs, KEYS, delta=0.1 * F.col("mean_c"), grow_order=["computation_date", "user_id"], grow_sigma_sq=1000.0)
    return rounded(out.select("variant_id", "effect", "se", "p_value", "adjusted_effect", "adjusted_se", "variance_reduction", "n_treatment", "n_control", "log_e", "tost_p", "segments", "q", "q_p", "grow_log_e", "grow_reject", "srm_p"))
