"""Two-sample inference from distributed sufficient statistics.

Observations have key columns (experiment, metric, ...), ``variant_id`` and ``y``; some
tests read a covariate ``x``, an assignment probability ``p``, a user or a time. One
aggregation reduces them to a row per key and arm; a join puts each treatment row beside
its control; all else is closed form on those rows. Only p-values and t or normal
quantiles meet Python, on result rows. Nulls in y are left out of every sum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemetric.functions import distributions as D
from tidemetric.functions.fdr import fdr_step
from tidemetric.sources.store import kept

CONTROL = "control"


def z_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def checked_alpha(alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    return alpha


def moments(obs: DataFrame, keys: list[str], covariate: bool = False) -> DataFrame:
    """n, mean and variance of y per key and arm, and with a covariate those of x and the covariance."""
    more = [F.avg("x").alias("mean_x"), F.var_samp("x").alias("var_x"), F.covar_samp("x", "y").alias("cov")] if covariate else []
    return obs.filter("y is not null").groupBy(*keys, "variant_id").agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.var_samp("y").alias("var"), *more)


def arm_pairs(arms: DataFrame, keys: list[str], control: str | None = CONTROL) -> DataFrame:
    """Each treatment arm beside its control: columns get _t and _c. No control named: the first by name."""
    values = [c for c in arms.columns if c not in (*keys, "variant_id")]
    if control is None:
        first = F.min("variant_id").over(Window.partitionBy(*keys)) if keys else F.min("variant_id").over(Window.partitionBy())
        named = arms.withColumn("is_control", F.col("variant_id") == F.coalesce(F.max(F.when(F.col("variant_id") == CONTROL, CONTROL)).over(Window.partitionBy(*keys)), first))
    else:
        named = arms.withColumn("is_control", F.col("variant_id") == control)
    t = named.filter(~F.col("is_control")).select(*keys, "variant_id", *[F.col(v).alias(f"{v}_t") for v in values])
    c = named.filter("is_control").select(*keys, *[F.col(v).alias(f"{v}_c") for v in values])
    return t.join(c, keys) if keys else t.crossJoin(c)


def _sound(pairs: DataFrame) -> DataFrame:
    return pairs.filter("n_t >= 2 and n_c >= 2")


def welch(pairs: DataFrame) -> DataFrame:
    """Effect, standard error, Welch-Satterthwaite df and t; arms of fewer than two rows drop out."""
    a, b = F.col("var_t") / F.col("n_t"), F.col("var_c") / F.col("n_c")
    se = F.sqrt(a + b)
    return _sound(pairs).withColumns({
        "effect": F.col("mean_t") - F.col("mean_c"), "se": se,
        "df": F.try_divide((a + b) * (a + b), a * a / (F.col("n_t") - 1) + b * b / (F.col("n_c") - 1)),
    }).withColumn("t", F.try_divide("effect", "se"))


def with_t_test(stats: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds the two-sided p-value and the t interval to effect, se, df, t."""
    half = D.t_quantile_of(1 - checked_alpha(alpha) / 2, F.col("df")) * F.col("se")
    return stats.withColumns({"p_value": D.t_p_value(F.col("t"), F.col("df")), "half": half}).withColumns({"ci_lower": F.col("effect") - F.col("half"), "ci_upper": F.col("effect") + F.col("half"), "significant": F.col("p_value") < alpha}).drop("half")


def srm_check(exposures: DataFrame, keys: list[str], expected: dict[str, float] | None = None) -> DataFrame:
    """χ² of distinct users per variant against expected shares (equal if none): chi_square, df, users."""
    seen = exposures.groupBy(*keys, "variant_id").agg(F.count_distinct("user_id").alias("users"))
    own = Window.partitionBy(*keys)
    share = F.lit(1.0) / F.count("*").over(own) if expected is None else F.element_at(F.create_map(*[F.lit(v) for pair in expected.items() for v in pair]), F.col("variant_id"))
    e = F.col("share") * F.sum("users").over(own)
    parts = seen.withColumn("share", share).withColumn("part", (F.col("users") - e) * (F.col("users") - e) / e)
    return parts.groupBy(*keys).agg(F.sum("part").alias("chi_square"), (F.count("*") - 1).alias("df"), F.sum("users").alias("users"))


def with_srm_p(stats: DataFrame, alpha: float = 0.001) -> DataFrame:
    return stats.withColumn("p_value", D.chi_square_p(F.col("chi_square"), F.col("df"))).withColumn("mismatch", F.col("p_value") < alpha)


def _pooled(u: str, v: str, cov: str) -> Column:
    """Sum of products around the pooled means, from both arms' moments."""
    n = F.col("n_t") + F.col("n_c")
    return (F.col("n_t") - 1) * F.col(f"{cov}_t") + (F.col("n_c") - 1) * F.col(f"{cov}_c") + F.col("n_t") * F.col("n_c") / n * (F.col(f"{u}_t") - F.col(f"{u}_c")) * (F.col(f"{v}_t") - F.col(f"{v}_c"))


def adjusted(pairs: DataFrame) -> DataFrame:
    """Covariate adjustment with pooled θ = cov / var (0 where x does not vary): effect, se, variance reduction.

    var(y - θx) = var y - 2θ cov + θ² var x, so the observations are not read again.
    """
    theta = F.coalesce(F.try_divide(_pooled("mean", "mean_x", "cov"), F.nullif(_pooled("mean_x", "mean_x", "var_x"), F.lit(0.0))), F.lit(0.0))
    own = lambda a: F.greatest(F.lit(0.0), F.col(f"var_{a}") - 2 * F.col("theta") * F.col(f"cov_{a}") + F.col("theta") * F.col("theta") * F.col(f"var_x_{a}"))
    out = _sound(pairs).withColumn("theta", theta).withColumns({"adj_t": own("t"), "adj_c": own("c")})
    raw, adj = F.col("var_t") / F.col("n_t") + F.col("var_c") / F.col("n_c"), F.col("adj_t") / F.col("n_t") + F.col("adj_c") / F.col("n_c")
    return out.withColumns({
        "raw_effect": F.col("mean_t") - F.col("mean_c"),
        "effect": F.col("mean_t") - F.col("mean_c") - F.col("theta") * (F.col("mean_x_t") - F.col("mean_x_c")),
        "se": F.sqrt(adj), "variance_reduction": F.coalesce(1 - F.try_divide(adj, raw), F.lit(0.0)),
    })


def cuped(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adjusted effect with the normal interval; rows whose covariate does not vary drop out."""
    z = z_quantile(1 - checked_alpha(alpha) / 2)
    out = adjusted(pairs.filter("var_x_t > 0 or var_x_c > 0 or mean_x_t <> mean_x_c"))
    return out.withColumns({"ci_lower": F.col("effect") - z * F.col("se"), "ci_upper": F.col("effect") + z * F.col("se")})


def avlm(pairs: DataFrame, tau_sq: float, alpha: float = 0.05) -> DataFrame:
    """Regression-adjusted anytime-valid interval from the normal-mixture boundary."""
    out = adjusted(pairs).withColumn("n_eff", 2.0 * F.col("n_t") * F.col("n_c") / (F.col("n_t") + F.col("n_c")))
    v, n = F.col("se") * F.col("se") * F.col("n_eff") / tau_sq, F.col("n_eff")
    bound = 2 * (v + n) / n * (math.log(1 / checked_alpha(alpha)) + 0.5 * F.ln(1 + F.try_divide(n, v)))
    out = out.withColumn("half_width", F.when(F.col("se") == 0, 0.0).otherwise(F.col("se") * F.sqrt(bound)))
    return out.withColumns({"ci_lower": F.col("effect") - F.col("half_width"), "ci_upper": F.col("effect") + F.col("half_width"), "significant": F.abs("effect") > F.col("half_width")})


def msprt(pairs: DataFrame, tau_sq: float, alpha: float = 0.05) -> DataFrame:
    """Mixture sequential probability ratio: log_lambda, always-valid p, crossed."""
    out = welch(pairs).withColumn("n_eff", 2.0 * F.col("n_t") * F.col("n_c") / (F.col("n_t") + F.col("n_c")))
    v, n, z = (F.col("var_t") + F.col("var_c")) / 2 / tau_sq, F.col("n_eff"), F.col("t")
    log_lambda = 0.5 * F.ln(v / (v + n)) + n * z * z / (2 * (v + n))
    return out.withColumn("log_lambda", log_lambda).withColumns({"always_valid_p": F.least(F.lit(1.0), F.exp(-F.col("log_lambda"))), "crossed": F.col("log_lambda") > math.log(1 / checked_alpha(alpha))})


def look_statistics(obs: DataFrame, keys: list[str], time: str, control: str = CONTROL) -> DataFrame:
    """z of every look: cumulative moments by ``time`` (a date) from daily sums and a running window."""
    daily = obs.filter("y is not null").groupBy(*keys, "variant_id", time).agg(F.count("y").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"))
    so_far = Window.partitionBy(*keys, "variant_id").orderBy(time)
    run = daily.select(*keys, "variant_id", time, *[F.sum(c).over(so_far).alias(c) for c in ("n", "s", "ss")])
    arms = run.filter("n >= 2").select(*keys, "variant_id", time, "n", (F.col("s") / F.col("n")).alias("mean"), ((F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("var"))
    looks = welch(arm_pairs(arms, [*keys, time], control))
    return looks.withColumn("look", F.row_number().over(Window.partitionBy(*keys, "variant_id").orderBy(time)))


def alpha_spent(fraction: Column, alpha: float, spending: str) -> Column:
    """Cumulative alpha at an information fraction: obrien_fleming or pocock."""
    if spending == "pocock":
        return alpha * F.ln(1 + (math.e - 1) * fraction)
    if spending == "obrien_fleming":
        return 2 * (1 - D.normal_cdf_of(F.lit(z_quantile(1 - alpha / 2)) / F.sqrt(fraction)))
    raise ValueError(f"no such spending function: {spending!r}")


def group_sequential(looks: DataFrame, boundaries: dict[int, float], alpha: float = 0.05, spending: str = "pocock") -> DataFrame:
    """Looks against a design's boundary per look (a short table of constants), with the alpha spent."""
    spark = looks.sparkSession
    table = spark.createDataFrame([(k, float(v)) for k, v in boundaries.items()], "look int, boundary double")
    out = looks.join(F.broadcast(table), "look")
    return out.withColumns({"crossed": F.abs("t") >= F.col("boundary"), "alpha_spent": alpha_spent(F.col("look") / F.lit(float(max(boundaries))), alpha, spending)})


#: About how many rows a range of an order holds, and so one task sorts.
ROWS_PER_RANGE = 200_000


def ranged(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """``rows``, stored, with ``range``: numbers that rise along (keys, order), of about equal rows each."""
    rows = kept(rows, "rows")
    ranges = -(-rows.count() // ROWS_PER_RANGE)
    if ranges <= 1:  # one range is all rows, as they are
        return rows.withColumn("range", F.lit(0))
    return kept(rows.repartitionByRange(ranges, *keys, *order).withColumn("range", F.spark_partition_id()), "ranges")


def earlier_sums(rows: DataFrame, keys: list[str], order: list[str | Column], value: str) -> DataFrame:
    """``rows`` with n_before and sum_before: count and sum of ``value`` over a key's earlier rows.

    Rows are dealt into ranges of the order of about equal size; the ranges of a key are
    summed first, and windows run within ranges alone: few keys make no long tasks.
    """
    dealt = ranged(rows, keys, order)
    back = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "range").agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    starts = sums.select(*keys, "range", F.coalesce(F.sum("n").over(back), F.lit(0)).alias("n_start"), F.coalesce(F.sum("s").over(back), F.lit(0.0)).alias("s_start"))
    own = Window.partitionBy(*keys, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumns({"n_own": F.count("*").over(own), "s_own": F.coalesce(F.sum(value).over(own), F.lit(0.0))})
    placed = within.join(starts, [*keys, "range"])
    return placed.withColumns({"n_before": F.col("n_start") + F.col("n_own"), "sum_before": F.col("s_start") + F.col("s_own")}).drop("range", "n_start", "s_start", "n_own", "s_own")


def e_value_grow(obs: DataFrame, keys: list[str], order: list[str], sigma_sq: float, alpha: float = 0.05) -> DataFrame:
    """Growth-rate e-value of y in a given order: the bet is the mean of earlier rows over σ².

    The result depends on row order, so order columns are required; ties must be broken by them.
    Sums of earlier rows are taken in two levels, so a key with most of all rows is no single task.
    """
    rows = obs.filter("y is not null").select(*keys, *order, "y")
    sums = earlier_sums(rows, keys, order, "y")
    bet = F.coalesce(F.try_divide("sum_before", "n_before"), F.lit(0.0)) / sigma_sq
    grown = sums.withColumn("bet", bet).groupBy(*keys).agg(F.sum(F.col("bet") * F.col("y") - 0.5 * F.col("bet") * F.col("bet") * sigma_sq).alias("log_e"), F.count("*").alias("n"))
    return grown.withColumns({"e_value": F.exp(F.least("log_e", F.lit(700.0))), "reject": F.col("log_e") > math.log(1 / checked_alpha(alpha))})


def e_value_adjusted(pairs: DataFrame, tau_sq: float, alpha: float = 0.05) -> DataFrame:
    """Gaussian-mixture e-value of the covariate-adjusted effect with the pooled residual variance."""
    dof = F.col("n_t") + F.col("n_c") - 1
    yy, xx, xy = _pooled("mean", "mean", "var") / dof, _pooled("mean_x", "mean_x", "var_x") / dof, _pooled("mean", "mean_x", "cov") / dof
    theta = F.when(xx < 2.220446049250313e-16, 0.0).otherwise(F.try_divide(xy, xx))
    out = _sound(pairs).withColumns({"theta": theta, "yy": yy, "xx": xx})
    sigma = F.greatest(F.col("yy") - F.col("theta") * F.col("theta") * F.col("xx"), F.col("yy") * 1e-12)
    out = out.withColumns({"effect": F.col("mean_t") - F.col("mean_c") - F.col("theta") * (F.col("mean_x_t") - F.col("mean_x_c")), "se_sq": sigma / F.col("n_t") + sigma / F.col("n_c")}).filter("se_sq > 0")
    s = F.col("se_sq")
    return out.withColumn("log_e", 0.5 * F.ln(s / (s + tau_sq)) + F.col("effect") * F.col("effect") * tau_sq / (2 * s * (s + tau_sq))).withColumn("reject", F.col("log_e") > math.log(1 / checked_alpha(alpha)))


def tost(stats: DataFrame, delta: Column) -> DataFrame:
    """Two one-sided t statistics against ±delta, from effect, se and df."""
    return stats.withColumn("delta", delta).withColumns({"t_lower": F.try_divide(F.col("effect") + F.col("delta"), F.col("se")), "t_upper": F.try_divide(F.col("delta") - F.col("effect"), F.col("se"))})


def with_tost_p(stats: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The larger of both one-sided p-values decides equivalence."""
    return stats.withColumn("p_value", F.greatest(D.t_upper_p(F.col("t_lower"), F.col("df")), D.t_upper_p(F.col("t_upper"), F.col("df")))).withColumn("equivalent", F.col("p_value") < checked_alpha(alpha))


def tost_cuped(pairs: DataFrame, delta: Column) -> DataFrame:
    """Equivalence of the covariate-adjusted effect; df by Welch-Satterthwaite on adjusted variances."""
    a, b = F.col("adj_t") / F.col("n_t"), F.col("adj_c") / F.col("n_c")
    return tost(adjusted(pairs).withColumn("df", F.try_divide((a + b) * (a + b), a * a / (F.col("n_t") - 1) + b * b / (F.col("n_c") - 1))), delta)


def tost_sample_size(pairs: DataFrame, delta: float, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Users per arm for equivalence within ±delta at a true effect of 0, and the power reached now."""
    z = z_quantile(1 - checked_alpha(alpha)) + z_quantile(1 - (1 - power) / 2)
    var = (F.col("var_t") + F.col("var_c")) / 2
    need = F.ceil(2 * var * (z / delta) ** 2)
    return _sound(pairs).withColumns({"n_per_arm": need.cast("long"), "z_now": delta / F.sqrt(F.col("var_t") / F.col("n_t") + F.col("var_c") / F.col("n_c")) - z_quantile(1 - alpha)})


def with_tost_power(stats: DataFrame) -> DataFrame:
    return stats.withColumn("power", F.greatest(F.lit(0.0), 2 * D.normal_cdf_of(F.col("z_now")) - 1))


def ipw(obs: DataFrame, keys: list[str], least: float = 0.01, alpha: float = 0.05, control: str = CONTROL) -> DataFrame:
    """Hájek means with sandwich errors under assignment probability ``p`` clipped to [least, 1 - least].

    Per arm the sums of w, wy, w², w²y and w²y² are enough: Σw²(y-μ)² expands to them.
    """
    w = 1 / F.least(F.greatest(F.col("p"), F.lit(least)), F.lit(1 - least))
    y = F.col("y")
    sums = obs.filter("y is not null").withColumn("w", w).groupBy(*keys, "variant_id").agg(
        F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * y).alias("wy"), F.sum(F.col("w") * F.col("w")).alias("ww"),
        F.sum(F.col("w") * F.col("w") * y).alias("wwy"), F.sum(F.col("w") * F.col("w") * y * y).alias("wwyy"),
        F.sum(((F.col("p") < least) | (F.col("p") > 1 - least)).cast("long")).alias("clipped"),
    )
    mu = F.col("wy") / F.col("w")
    arms = sums.withColumn("mean", mu).withColumn("v", (F.col("wwyy") - 2 * F.col("mean") * F.col("wwy") + F.col("mean") * F.col("mean") * F.col("ww")) / (F.col("w") * F.col("w")))
    z = z_quantile(1 - checked_alpha(alpha) / 2)
    return arm_pairs(arms, keys, control).withColumns({
        "effect": F.col("mean_t") - F.col("mean_c"), "se": F.sqrt(F.col("v_t") + F.col("v_c")), "clipped": F.col("clipped_t") + F.col("clipped_c"),
        "ess": (F.col("w_t") + F.col("w_c")) * (F.col("w_t") + F.col("w_c")) / (F.col("ww_t") + F.col("ww_c")),
    }).withColumns({"ci_lower": F.col("effect") - z * F.col("se"), "ci_upper": F.col("effect") + z * F.col("se")})


def clustered(obs: DataFrame, keys: list[str], cluster: str, control: str = CONTROL) -> DataFrame:
    """Difference in means with HC1 cluster-robust error, per treatment arm.

    A cluster that is in one arm contributes its residual sum Σy - n·mean. Two aggregations:
    (n, Σy, Σy²) per cluster and arm, then the meat per arm.
    """
    own = obs.filter("y is not null").groupBy(*keys, "variant_id", cluster).agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"))
    arms = own.groupBy(*keys, "variant_id").agg(
        F.sum("n").alias("n"), F.count("*").alias("g"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
        F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum(F.col("s") * F.col("n")).alias("sn"), F.sum(F.col("n") * F.col("n")).alias("n2"),
    ).withColumn("mean", F.col("s") / F.col("n"))
    arms = arms.withColumns({"meat": F.col("s2") - 2 * F.col("mean") * F.col("sn") + F.col("mean") * F.col("mean") * F.col("n2"), "rss": F.col("ss") - F.col("n") * F.col("mean") * F.col("mean")})
    pairs = arm_pairs(arms, keys, control)
    g, n = F.col("g_t") + F.col("g_c"), F.col("n_t") + F.col("n_c")
    robust = F.col("meat_t") / (F.col("n_t") * F.col("n_t")) + F.col("meat_c") / (F.col("n_c") * F.col("n_c"))
    plain = (F.col("rss_t") + F.col("rss_c")) / (n - 2) * (1 / F.col("n_t") + 1 / F.col("n_c"))
    return pairs.filter("g_t >= 2 and g_c >= 2").withColumns({
        "effect": F.col("mean_t") - F.col("mean_c"), "naive_se": F.sqrt(plain), "se": F.sqrt(robust * g / (g - 1) * n / (n - 2)),
        "df": (g - 1).cast("double"), "clusters": g,
    }).withColumns({"t": F.try_divide("effect", "se"), "design_effect": F.try_divide(F.col("se") * F.col("se"), F.col("naive_se") * F.col("naive_se"))})


def cochran_q(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Heterogeneity of segment effects (effect, se): Q, df and p, I² in percent and the pooled effect; one segment has p 1."""
    w = 1 / (F.col("se") * F.col("se"))
    sums = segments.filter("se > 0").groupBy(*keys).agg(F.count("*").alias("k"), F.sum(w).alias("w"), F.sum(w * F.col("effect")).alias("we"), F.sum(w * F.col("effect") * F.col("effect")).alias("wee"))
    q = F.greatest(F.lit(0.0), F.col("wee") - F.col("we") * F.col("we") / F.col("w"))
    out = sums.withColumns({"q": q, "df": (F.col("k") - 1).cast("double"), "pooled_effect": F.col("we") / F.col("w")})
    return out.withColumn("i_squared", F.coalesce(F.greatest(F.lit(0.0), F.try_divide(F.col("q") - F.col("df"), F.col("q"))) * 100, F.lit(0.0))).withColumn("p_value", F.when(F.col("df") < 1, 1.0).otherwise(D.chi_square_p(F.col("q"), F.col("df")))).select(*keys, "k", "q", "df", "p_value", "i_squared", "pooled_effect")


def bonferroni(tests: DataFrame, keys: list[str], alpha: float = 0.05, p: str = "p_value") -> DataFrame:
    """Adjusted p = min(1, p·K) within ``keys``; reject at p ≤ α / K."""
    k = F.count(p).over(Window.partitionBy(*keys))
    return tests.withColumns({"p_adjusted": F.least(F.lit(1.0), F.col(p) * k), "reject": F.col(p) <= alpha / k})


def benjamini_hochberg(tests: DataFrame, keys: list[str], fdr: float = 0.05, p: str = "p_value", tie: str = "variant_id") -> DataFrame:
    """Adjusted p: running minimum of p·n / rank from the largest p; reject at adjusted p ≤ fdr.

    Ranks and the running minimum come in two levels, by ranges of p: a key with most of all
    tests, or no key at all, is no single task. A null p is no test.
    """
    dealt = ranged(tests.filter(F.col(p).isNotNull()), keys, [p, tie])
    sums = dealt.groupBy(*keys, "range").agg(F.count("*").alias("n"))
    all_ranges = Window.partitionBy(*keys)
    back = all_ranges.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "range", F.coalesce(F.sum("n").over(back), F.lit(0)).alias("start"), F.sum("n").over(all_ranges).alias("tests"))
    own = Window.partitionBy(*keys, "range").orderBy(p, tie)
    scaled = dealt.withColumn("own", F.row_number().over(own)).join(starts, [*keys, "range"]).withColumn("scaled", F.col(p) * F.col("tests") / (F.col("start") + F.col("own")))
    onward = all_ranges.orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    lowest = scaled.groupBy(*keys, "range").agg(F.min("scaled").alias("lowest"))
    later = lowest.select(*keys, "range", F.min("lowest").over(onward).alias("later"))
    adjusted_p = F.least(F.lit(1.0), F.col("later"), F.min("scaled").over(own.rowsBetween(Window.currentRow, Window.unboundedFollowing)))  # nulls don't count
    out = scaled.join(later, [*keys, "range"]).withColumn("p_adjusted", adjusted_p).withColumn("reject", F.col("p_adjusted") <= fdr)
    return out.select(*tests.columns, "p_adjusted", "reject")


def online_fdr(tests: DataFrame, keys: list[str], order: str, alpha: float = 0.05, decay: float = 0.5) -> DataFrame:
    """Tests, rejections and wealth left per key, e-values taken in order; ``streaming.stateful.online_fdr_stream`` decides as they come.

    Wealth feeds back, so a key's tests are one after the other: they stream through a task in
    order, which holds one state and never a key's history.
    """
    kinds = ", ".join(f"{k} {t}" for k, t in tests.dtypes if k in keys)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            done = []
            for *own, e in batch[[*keys, "e_value"]].itertuples(index=False):
                if own != key:
                    if key is not None:
                        done.append((*key, *state))
                    key, state = own, (0, 0, alpha)
                _, hit, wealth = fdr_step(state[2], state[0], None if pd.isna(e) else float(e), alpha, decay)
                state = (state[0] + 1, state[1] + int(hit), wealth)
            yield pd.DataFrame(done, columns=[*keys, "tests", "rejections", "wealth"])
        if key is not None:
            yield pd.DataFrame([(*key, *state)], columns=[*keys, "tests", "rejections", "wealth"])

    ordered = tests.select(*keys, order, "e_value").repartition(*keys).sortWithinPartitions(*keys, order, "e_value")
    return ordered.mapInPandas(fold, f"{kinds}, tests int, rejections int, wealth double")


def bayes_normal(pairs: DataFrame, prior_mean: float = 0.0, prior_var: float = 1.0, alpha: float = 0.05) -> DataFrame:
    """Posterior of the effect under a normal prior: mean, sd, z of superiority and credible interval."""
    stats = welch(pairs).filter("se > 0")
    precision = 1 / (F.col("se") * F.col("se")) + 1 / prior_var
    out = stats.withColumns({"posterior_mean": (F.col("effect") / (F.col("se") * F.col("se")) + prior_mean / prior_var) / precision, "posterior_sd": F.sqrt(1 / precision)})
    z = z_quantile(1 - checked_alpha(alpha) / 2)
    return out.withColumns({"z": F.col("posterior_mean") / F.col("posterior_sd"), "ci_lower": F.col("posterior_mean") - z * F.col("posterior_sd"), "ci_upper": F.col("posterior_mean") + z * F.col("posterior_sd")})


def adaptive_sample_size(obs: DataFrame, keys: list[str], delta: float, planned: int, alpha: float = 0.05) -> DataFrame:
    """Blinded pooled variance, the non-centrality δ√(n/2)/σ now and at the planned size per arm."""
    pooled = obs.filter("y is not null").groupBy(*keys).agg(F.var_samp("y").alias("blinded_var"), (F.count("*") / F.count_distinct("variant_id")).alias("n_per_arm"))
    ncp = lambda n: delta * F.sqrt(n / 2) / F.sqrt("blinded_var")
    return pooled.withColumns({"ncp_now": ncp(F.col("n_per_arm")), "ncp_planned": ncp(F.lit(float(planned)))})


def with_conditional_power(sizes: DataFrame, delta: float, alpha: float = 0.05, most_times: float = 2.0, planned: int = 0) -> DataFrame:
    """Conditional power Φ(ncp-z) + Φ(-ncp-z) and its zone; in the promising zone the size that reaches 0.9."""
    z = z_quantile(1 - alpha / 2)
    out = sizes.withColumn("power", D.normal_cdf_of(F.col("ncp_planned") - z) + D.normal_cdf_of(-F.col("ncp_planned") - z))
    need = F.ceil(2 * F.col("blinded_var") * ((z + z_quantile(0.9)) / delta) ** 2)
    zone = F.when(F.col("power") >= 0.9, "favorable").when(F.col("power") >= 0.3, "promising").otherwise("futile")
    return out.withColumn("zone", zone).withColumn("extended_n", F.when(F.col("zone") == "promising", F.least(need, F.lit(int(most_times * planned)))).otherwise(planned).cast("long"))
