"""Analyses over metric tables: interference, interleaving, surrogates, guardrails, shadow runs, portfolio."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemetric.functions import distributions as D
from tidemetric.operators.catalog import gini
from tidemetric.operators.inference import benjamini_hochberg
from tidemetric.sources.store import kept


def consumption_divergence(consumption: DataFrame, treatment: str, control: str = "control", top: int = 100) -> DataFrame:
    """Jensen-Shannon divergence, top-K Jaccard, Gini and coverage of watch time, treatment against control.

    ``consumption`` is (variant_id, content_id, watch_time_seconds). One row.
    """
    side = lambda v, a: consumption.filter(F.col("variant_id") == v).groupBy("content_id").agg(F.sum("watch_time_seconds").alias(a))
    both = side(treatment, "t").join(side(control, "c"), "content_id", "full_outer").fillna(0.0, ["t", "c"])
    totals = both.agg(F.sum("t").alias("all_t"), F.sum("c").alias("all_c"))
    shares = both.crossJoin(F.broadcast(totals)).select("content_id", "t", "c", (F.col("t") / F.col("all_t")).alias("p"), (F.col("c") / F.col("all_c")).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / m)).otherwise(0.0)
    first = lambda x: F.broadcast(both.filter(F.col(x) > 0).orderBy(F.desc(x), "content_id").limit(top).select("content_id", F.lit(True).alias(f"in_{x}")))
    ranked = shares.join(first("t"), "content_id", "left").join(first("c"), "content_id", "left").withColumns({"jt": part("p"), "jc": part("q")})
    in_t, in_c = F.coalesce("in_t", F.lit(False)), F.coalesce("in_c", F.lit(False))
    out = ranked.agg(
        (0.5 * F.sum("jt") + 0.5 * F.sum("jc")).alias("js_divergence"),
        F.try_divide(F.sum((in_t & in_c).cast("int")), F.sum((in_t | in_c).cast("int"))).alias("top_jaccard"),
        F.avg((F.col("t") > 0).cast("double")).alias("treatment_coverage"), F.avg((F.col("c") > 0).cast("double")).alias("control_coverage"),
    )
    long = both.select("content_id", F.inline(F.array(F.struct(F.lit("treatment").alias("variant_id"), F.col("t").alias("n")), F.struct(F.lit("control").alias("variant_id"), F.col("c").alias("n")))))
    ginis = gini(long, "content_id").groupBy().pivot("variant_id", ["treatment", "control"]).agg(F.first("metric_value"))
    return out.crossJoin(ginis.select(F.col("treatment").alias("treatment_gini"), F.col("control").alias("control_gini")))


def title_spillover(consumption: DataFrame, treatment: str, control: str = "control") -> DataFrame:
    """Two-proportion z per content that both arms watched, from (variant_id, content_id, view_count); see ``spillover_tests``."""
    totals = consumption.groupBy("variant_id").agg(F.sum("view_count").alias("total"))
    rows = consumption.join(F.broadcast(totals), "variant_id")
    side = lambda v, s: rows.filter(F.col("variant_id") == v).select("content_id", F.col("view_count").alias(f"n_{s}"), F.col("total").alias(f"total_{s}"))
    both = side(treatment, "t").join(side(control, "c"), "content_id").filter("n_t > 0 and n_c > 0")
    pooled = (F.col("n_t") + F.col("n_c")) / (F.col("total_t") + F.col("total_c"))
    se = F.sqrt(pooled * (1 - pooled) * (1 / F.col("total_t") + 1 / F.col("total_c")))
    return both.withColumn("z", F.try_divide(F.col("n_t") / F.col("total_t") - F.col("n_c") / F.col("total_c"), se))


def spillover_tests(spillover: DataFrame, alpha: float = 0.05) -> DataFrame:
    """p per content, adjusted over contents by false discovery rate, and whether the content spills over; without a z, p is 1."""
    tests = spillover.select("content_id", "z", F.coalesce(D.normal_p_value(F.col("z")), F.lit(1.0)).alias("p_value"))
    return benjamini_hochberg(tests, [], alpha, tie="content_id").select("content_id", "z", "p_value", "p_adjusted", F.col("reject").alias("spills_over"))


def interference_decision(divergence: DataFrame, spillover: DataFrame, js_threshold: float = 0.05) -> DataFrame:
    """Interference is detected by the divergence over its threshold, or by any content that spills over."""
    titles = spillover.agg(F.count(F.when(F.col("spills_over"), 1)).alias("spillover_titles"))
    out = divergence.crossJoin(F.broadcast(titles))
    return out.withColumn("interference_detected", (F.col("js_divergence") > js_threshold) | (F.col("spillover_titles") > 0))


def win_test(wins: DataFrame, algorithms: list[str]) -> DataFrame:
    """One row: whether users' winners differ; exact sign test of two algorithms, χ² of more; p is 1 without decisive users."""
    rows = wins.filter(F.col("algorithm").isin(*algorithms)).select("algorithm", "wins")
    count = lambda a: F.coalesce(F.sum(F.when(F.col("algorithm") == a, F.col("wins"))), F.lit(0))
    one = rows.agg(*[count(a).alias(f"wins_{i}") for i, a in enumerate(algorithms)], F.coalesce(F.sum("wins"), F.lit(0)).alias("decisive"))
    if len(algorithms) == 2:
        return one.select("decisive", D.sign_test_p(F.col("wins_0"), F.col("wins_1")).alias("p_value"))
    even = F.col("decisive") / len(algorithms)
    chi = sum(((F.col(f"wins_{i}") - even) * (F.col(f"wins_{i}") - even) for i in range(len(algorithms))), F.lit(0.0))
    p = D.chi_square_p(F.try_divide(chi, even), F.lit(len(algorithms) - 1.0))
    return one.select("decisive", F.when(F.col("decisive") == 0, 1.0).otherwise(p).alias("p_value"))


def win_rates(scores: DataFrame) -> DataFrame:
    """Wins and rate per algorithm among users with a single winner."""
    wins = scores.filter("winning_algorithm_id is not null").groupBy(F.col("winning_algorithm_id").alias("algorithm")).agg(F.count("*").alias("wins"))
    return wins.withColumn("win_rate", F.col("wins") / F.sum("wins").over(Window.partitionBy()))


def mean_positive_credit(scores: DataFrame) -> DataFrame:
    """Mean of each algorithm's positive credits."""
    return scores.select(F.explode("algorithm_scores").alias("algorithm", "credit")).groupBy("algorithm").agg(F.avg(F.when(F.col("credit") > 0, F.col("credit"))).alias("mean_credit"))


def pairwise_wins(scores: DataFrame) -> DataFrame:
    """(winner, loser, wins): each user's winner against the other algorithms in their map."""
    rows = scores.filter("winning_algorithm_id is not null").select(F.col("winning_algorithm_id").alias("winner"), F.explode(F.map_keys("algorithm_scores")).alias("loser"))
    return rows.filter("winner <> loser").groupBy("winner", "loser").agg(F.count("*").alias("wins"))


def bradley_terry(wins: DataFrame, smoothing: float = 0.5, passes: int = 1000, least: float = 1e-8) -> DataFrame:
    """Strengths of algorithms from K × K win counts by minorise-maximise, with log-scale 95 % intervals."""

    def fit(table: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*table["winner"], *table["loser"]})
        at = {n: i for i, n in enumerate(names)}
        k = len(names)
        w = np.full((k, k), smoothing) * (1 - np.eye(k))
        for winner, loser, count in zip(table["winner"], table["loser"], table["wins"], strict=True):
            w[at[winner], at[loser]] += count
        games, pi = w + w.T, np.full(k, 1 / k)
        for _ in range(passes):
            new = w.sum(1) / np.maximum((games / (pi[:, None] + pi[None, :])).sum(1), 1e-300)
            new /= new.sum()
            done = np.abs(new - pi).max() < least
            pi = new
            if done:
                break
        information = (games * pi[:, None] * pi[None, :] / (pi[:, None] + pi[None, :]) ** 2).sum(1)
        se = 1 / np.sqrt(np.maximum(information, 1e-300))
        return pd.DataFrame({"algorithm": names, "strength": pi, "ci_lower": np.exp(np.log(pi) - 1.96 * se), "ci_upper": np.exp(np.log(pi) + 1.96 * se)})

    return wins.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "algorithm string, strength double, ci_lower double, ci_upper double")


def linear_surrogate(inputs: DataFrame, coefficients: dict[str, float], intercept: float, r_squared: float, control: str = "control") -> DataFrame:
    """Projected long-term effect per variant: intercept + Σ coefficient · mean, against control.

    ``inputs`` is the surrogate input (variant_id, metric_id, avg_value).
    """
    weights = F.create_map(*[F.lit(v) for kv in coefficients.items() for v in kv])
    scored = inputs.groupBy("variant_id").agg((F.lit(intercept) + F.coalesce(F.sum(F.col("avg_value") * F.try_element_at(weights, F.col("metric_id"))), F.lit(0.0))).alias("projected"))
    base = scored.filter(F.col("variant_id") == control).select(F.col("projected").alias("control_projected"))
    spread = ((1 - r_squared) / r_squared) ** 0.5 if 0 < r_squared < 1 else 0.5
    out = scored.filter(F.col("variant_id") != control).crossJoin(F.broadcast(base)).withColumn("projected_effect", F.col("projected") - F.col("control_projected"))
    half = 1.96 * spread * F.abs("projected_effect")
    return out.withColumns({"ci_lower": F.col("projected_effect") - half, "ci_upper": F.col("projected_effect") + half})


def surrogate_calibration(pairs: DataFrame) -> DataFrame:
    """R², RMSE, bias and error deviation of (projected, actual), with a badge; one row."""
    error = F.col("projected") - F.col("actual")
    mean = F.avg("actual").over(Window.partitionBy())
    centred = pairs.withColumns({"e": error, "d": F.col("actual") - mean})
    out = centred.agg(F.count("*").alias("n"), (1 - F.try_divide(F.sum(F.col("e") * F.col("e")), F.sum(F.col("d") * F.col("d")))).alias("r_squared"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"), F.stddev_samp("e").alias("error_sd"))
    return out.withColumn("badge", F.when(F.col("r_squared") >= 0.7, "green").when(F.col("r_squared") >= 0.5, "yellow").otherwise("red"))


def surrogate_recalibration(projections: DataFrame, actuals: DataFrame, current_r_squared: float) -> DataFrame:
    """New R² of projected against actual effects; the model keeps its own with under two points or no spread."""
    pairs = projections.select("experiment_id", F.col("projected_effect").alias("projected")).join(actuals.select("experiment_id", F.col("actual_effect").alias("actual")), "experiment_id")
    out = surrogate_calibration(pairs)
    fresh = F.when((F.col("n") >= 2) & F.col("r_squared").isNotNull(), F.greatest(F.lit(0.0), F.col("r_squared")))
    return out.select("n", F.coalesce(fresh, F.lit(current_r_squared)).alias("r_squared"))


def adjust_projections(projections: DataFrame, calibration: DataFrame) -> DataFrame:
    """Projections (projected, se) less the calibration's bias, with an interval widened by its error."""
    out = projections.crossJoin(F.broadcast(calibration.select("bias", "error_sd"))).withColumn("adjusted", F.col("projected") - F.col("bias"))
    half = 1.96 * F.sqrt(F.col("se") * F.col("se") + F.coalesce("error_sd", F.lit(0.0)) * F.coalesce("error_sd", F.lit(0.0)))
    return out.withColumns({"ci_lower": F.col("adjusted") - half, "ci_upper": F.col("adjusted") + half})


def backtest_surrogate(rows: DataFrame) -> DataFrame:
    """Coverage, mean absolute error, median absolute percentage error and share within 25 % of (projected, ci_lower, ci_upper, actual)."""
    off = F.abs(F.col("projected") - F.col("actual"))
    ape = F.try_divide(off, F.abs("actual"))
    out = rows.agg(F.count("*").alias("n"), F.avg(F.col("actual").between(F.col("ci_lower"), F.col("ci_upper")).cast("double")).alias("coverage"), F.avg(off).alias("mae"), F.percentile(ape, 0.5).alias("median_ape"), F.avg((ape <= 0.25).cast("double")).alias("within_quarter"))
    return out.withColumn("passes", (F.col("coverage") >= 0.9) & (F.col("median_ape") <= 0.25))


def feedback_loop(contamination: DataFrame) -> DataFrame:
    """Paired t of post against pre effects, correlation of post effects with the training share, OLS slope and intercept.

    The intercept is the effect corrected for contamination. Without a spread of shares or
    effects correlation and slope are 0. Needs three retrainings or more.
    """
    change = F.col("post_effect") - F.col("pre_effect")
    share = "treatment_contamination_fraction"
    out = contamination.withColumn("change", change).agg(
        F.count("*").alias("n"), F.avg("change").alias("mean_change"), F.stddev_samp("change").alias("sd"), F.avg("post_effect").alias("mean_post"), F.avg(share).alias("mean_share"),
        F.covar_samp(share, "post_effect").alias("cov"), F.var_samp(share).alias("var_share"), F.var_samp("post_effect").alias("var_post"),
    )
    correlation = F.coalesce(F.try_divide("cov", F.sqrt("var_share") * F.sqrt("var_post")), F.lit(0.0))
    slope = F.coalesce(F.try_divide("cov", "var_share"), F.lit(0.0))
    out = out.withColumns({"correlation": correlation, "slope": slope, "corrected_effect": F.col("mean_post") - slope * F.col("mean_share")}).drop("mean_post", "mean_share", "cov", "var_share", "var_post")
    return out.filter("n >= 3").withColumn("t", F.try_divide("mean_change", F.col("sd") / F.sqrt("n"))).drop("sd")


def feedback_decision(loop: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The paired test's p, and whether a feedback loop is detected: p < α with a strong correlation, or p < α / 2."""
    out = loop.withColumn("p_value", F.coalesce(D.t_p_value(F.col("t"), F.col("n") - 1.0), F.lit(1.0)))
    strong = F.coalesce(F.abs("correlation") > 0.5, F.lit(False))
    return out.withColumn("detected", ((F.col("p_value") < alpha) & strong) | (F.col("p_value") < alpha / 2))


def guardrail_breaches(checks: DataFrame, threshold: float, lower_is_better: bool, consecutive: int) -> DataFrame:
    """Runs of breached checks (experiment_id, metric_id, variant_id, check_time, current_value) of ``consecutive`` or more."""
    keys = ["experiment_id", "metric_id", "variant_id"]
    breached = (F.col("current_value") > threshold) if lower_is_better else (F.col("current_value") < threshold)
    own = Window.partitionBy(*keys).orderBy("check_time")
    rows = checks.withColumn("breached", breached).withColumn("goods", F.sum((~F.col("breached")).cast("int")).over(own))
    runs = rows.filter("breached").groupBy(*keys, "goods").agg(F.min("check_time").alias("since"), F.max("check_time").alias("until"), F.count("*").alias("run"))
    return runs.filter(F.col("run") >= consecutive).drop("goods")


def shadow_diff(original: DataFrame, candidate: DataFrame, exact: Column | bool = False, least: float = 1e-9) -> DataFrame:
    """Candidate against original per key (shadow_id, variant_id, metric_date): relative error over max(|original|, 1).

    A side that is missing does not pass. Exact metrics (counts, proportions) pass only when equal.
    """
    keys = ["shadow_id", "variant_id", "metric_date"]
    both = original.select(*keys, F.col("metric_value").alias("original")).join(candidate.select(*keys, F.col("metric_value").alias("candidate")), keys, "full_outer")
    error = F.abs(F.col("candidate") - F.col("original")) / F.greatest(F.abs("original"), F.lit(1.0))
    is_exact = F.lit(exact) if isinstance(exact, bool) else exact
    passes = F.coalesce(F.when(is_exact, F.col("candidate") == F.col("original")).otherwise(error <= least), F.lit(False))
    return both.withColumns({"relative_error": error, "passes": passes})


def shadow_promotion(diffs: DataFrame, days: int = 7) -> DataFrame:
    """pending under ``days`` days; approved when every tuple passes on contiguous days, enough of them; else rejected."""
    out = diffs.groupBy("shadow_id").agg(F.count_distinct("metric_date").alias("days"), (F.datediff(F.max("metric_date"), F.min("metric_date")) + 1).alias("span"), F.bool_and("passes").alias("all_pass"))
    status = F.when(F.col("days") < days, "pending").when(F.col("all_pass") & (F.col("days") == F.col("span")), "approved").otherwise("rejected")
    return out.withColumn("status", status)


def portfolio_outcomes(results: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Learning, decision and annualised impact per experiment row.

    Reads effect, p_value, power, guardrail_breached, elapsed (share of the planned run) and daily_users.
    """
    sure = F.col("p_value") < alpha
    learning = F.when(sure & (F.col("effect") > 0), "winner").when(sure, "loser").when(F.col("power") >= 0.8, "null").when(F.col("p_value") < 2 * alpha, "directional").otherwise("inconclusive")
    decision = (
        F.when(F.col("guardrail_breached"), "stop").when(sure & (F.col("effect") > 0), "ship").when(sure, "stop").when(F.col("elapsed") >= 1, "stop").when((F.col("elapsed") >= 0.5) & (F.col("power") < 0.5), "extend").otherwise("continue")
    )
    return results.withColumns({"learning": learning, "decision": decision, "annual_impact": F.col("effect") * F.col("daily_users") * 365})


def portfolio_summary(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    return outcomes.groupBy(*keys).agg(F.count("*").alias("experiments"), F.avg((F.col("learning") == "winner").cast("double")).alias("win_rate"), F.sum(F.when(F.col("learning") == "winner", F.col("annual_impact"))).alias("annual_impact"))


def portfolio_conflicts(experiments: DataFrame) -> DataFrame:
    """Pairs of experiments in a layer that share a metric or a population.

    Reads experiment_id, layer, metrics (array) and populations (array). Experiments of a layer
    with the same items are one class. Classes meet by what they share, each pair of them is
    counted once, and its members are paired last: a pair of experiments is made once, is not
    shuffled, and pairs without anything in common are never made.
    """
    named = lambda kind, items: F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda m: F.concat(F.lit(kind), m))
    items = F.concat(named("metric:", F.col("metrics")), named("population:", F.col("populations")))
    each = experiments.select("experiment_id", "layer", F.explode(items).alias("item"))
    own = each.filter("item is not null").groupBy("experiment_id", "layer").agg(F.sort_array(F.collect_set("item")).alias("items"))  # items of one experiment
    members = kept(own, "conflict-members")
    classes = kept(members.groupBy("layer", "items").agg(F.min("experiment_id").alias("class")), "conflict-classes")
    met = classes.select("layer", "class", F.explode("items").alias("item"))
    a, b = met.alias("a"), met.alias("b")
    shared = a.join(b, (F.col("a.layer") == F.col("b.layer")) & (F.col("a.item") == F.col("b.item"))).groupBy(F.col("a.layer").alias("layer"), F.col("a.class").alias("class"), F.col("b.class").alias("other")).agg(F.count("*").alias("shared"))
    named_members = kept(members.join(classes, ["layer", "items"]).select("layer", "class", "experiment_id"), "conflict-named")
    left, right = named_members.withColumnRenamed("experiment_id", "first"), named_members.select("layer", F.col("class").alias("other"), F.col("experiment_id").alias("second"))
    return shared.join(left, ["layer", "class"]).join(right, ["layer", "other"]).filter("first < second").select("layer", "first", "second", "shared")


def traffic_utilisation(allocations: DataFrame, buckets: int = 10_000) -> DataFrame:
    """Share of each layer's buckets in use from inclusive ranges (layer, first, last)."""
    return allocations.groupBy("layer").agg((F.sum(F.col("last") - F.col("first") + 1) / buckets).alias("utilisation"), F.count("*").alias("experiments"))
