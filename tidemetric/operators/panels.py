"""Time-series designs: novelty, switchback and synthetic control.

Events are aggregated to a short series per experiment in Spark. What needs array code
runs in one group per experiment (or per placebo unit, or per block of permutations),
on a series whose length is the number of days, blocks or periods.
"""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemetric.functions import distributions as D


def novelty(daily: DataFrame, keys: list[str], grid: int = 20) -> DataFrame:
    """Weighted fit of s + a·exp(-t/d) to daily effects (day, effect, sample_size); d over a grid.

    Detected when the 95 % interval of a excludes 0 and d < 14; stabilised when the last seven
    days lie within 10 % of s. Fewer than seven days give no row.
    """

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("day")
        t, y, w = (group[c].to_numpy(float) for c in ("day", "effect", "sample_size"))
        t = t - t[0]
        best = None
        if len(t) >= 7:
            for d in np.geomspace(0.5, 60, grid):
                x = np.column_stack([np.ones_like(t), np.exp(-t / d)])
                xtx = (x * w[:, None]).T @ x
                if np.linalg.cond(xtx) > 1e12:
                    continue
                beta = np.linalg.solve(xtx, (x * w[:, None]).T @ y)
                rss = float((w * (y - x @ beta) ** 2).sum())
                if best is None or rss < best[0]:
                    best = (rss, d, beta, np.linalg.inv(xtx))
        if best is None:
            return pd.DataFrame(columns=columns, dtype=object)
        rss, d, (s, a), cov = best
        se = np.sqrt(max(rss / max(len(t) - 3, 1) * cov[1, 1], 0.0))
        last = np.abs(y[-7:] - s) <= 0.1 * max(abs(s), 1e-12)
        return pd.DataFrame([[*(group[k].iloc[0] for k in keys), s, a, d, se, bool(abs(a) > 1.96 * se and d < 14), bool(last.all())]], columns=columns)

    columns = [*keys, "steady_effect", "novelty_amplitude", "decay_days", "amplitude_se", "detected", "stabilised"]
    kinds = ", ".join(f"{k} {t}" for k, t in daily.dtypes if k in keys)
    return daily.groupBy(*keys).applyInPandas(fit, f"{kinds}, steady_effect double, novelty_amplitude double, decay_days double, amplitude_se double, detected boolean, stabilised boolean")


def switchback_series(events: DataFrame, keys: list[str]) -> DataFrame:
    """Mean value per block and arm of events with block, washout and arm; washout is left out."""
    return events.filter(~F.col("washout")).groupBy(*keys, "block", "arm").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def switchback_effect(series: DataFrame, keys: list[str]) -> DataFrame:
    """Block OLS of value on arm with Newey-West errors, all in window and group sums.

    Scores (d - d̄)·ε have a lag-1 autocorrelation that sets the bandwidth
    ⌈1.1447·(2ρ²/(1-ρ²)·T)^⅓⌉ in [1, T-1]; lag products come from a self-join within it.
    """
    base = series.groupBy(*keys).agg(F.count("*").alias("blocks"), F.avg("arm").alias("d_mean"), F.regr_slope("value", "arm").alias("effect"), F.regr_intercept("value", "arm").alias("intercept"), F.regr_sxx("value", "arm").alias("sxx"))
    order = Window.partitionBy(*keys).orderBy("block")
    scored = series.join(base, keys).filter("sxx > 1e-15").withColumn("s", (F.col("arm") - F.col("d_mean")) * (F.col("value") - F.col("intercept") - F.col("effect") * F.col("arm"))).withColumns({"at": F.row_number().over(order), "prior": F.lag("s").over(order)})
    mean = F.avg("s").over(Window.partitionBy(*keys))
    lag1 = scored.withColumns({"c": F.col("s") - mean, "cp": F.col("prior") - mean}).groupBy(*keys, "blocks", "sxx", "effect").agg(F.coalesce(F.try_divide(F.sum(F.col("c") * F.col("cp")), F.sum(F.col("c") * F.col("c"))), F.lit(0.0)).alias("rho"))
    rho = F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), F.col("rho")))
    width = F.ceil(1.1447 * F.pow(2 * rho * rho / (1 - rho * rho) * F.col("blocks"), 1.0 / 3.0))
    banded = lag1.withColumn("h", F.least(F.greatest(width, F.lit(1)), F.col("blocks") - 1).cast("int"))
    left = scored.select(*keys, F.col("at").alias("i"), F.col("s").alias("si"))
    offsets = scored.select(*keys, F.col("at"), "s").join(banded.select(*keys, "h"), keys).select(*keys, "s", "h", "at", F.explode(F.sequence(F.lit(0), F.col("h"))).alias("step"))
    near = offsets.withColumn("i", F.col("at") + F.col("step")).join(left, [*keys, "i"])
    weight = F.when(F.col("step") == 0, 1.0).otherwise(2 * (1 - F.col("step") / (F.col("h") + 1.0)))
    omega = near.groupBy(*keys).agg(F.sum(weight * F.col("s") * F.col("si")).alias("omega"))
    out = banded.join(omega, keys).join(carry_over(scored, keys), keys)
    se = F.sqrt(F.greatest(F.lit(0.0), F.col("omega")) / (F.col("sxx") * F.col("sxx")))
    return out.select(*keys, "blocks", "effect", F.col("h").alias("bandwidth"), se.alias("se"), "lag1_autocorrelation", "carry_over_t", "carry_over_p")


def carry_over(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Lag-1 autocorrelation r of the residuals, its t = r √((T - 2) / (1 - r²)) and p; p is 1 under four blocks or where |r| is 1."""
    order = Window.partitionBy(*keys).orderBy("block")
    left_over = scored.withColumn("e", F.col("value") - F.col("intercept") - F.col("effect") * F.col("arm")).withColumn("e_before", F.lag("e").over(order))
    sums = left_over.groupBy(*keys).agg(F.count("*").alias("t"), F.sum(F.col("e") * F.col("e_before")).alias("cross"), F.sum(F.col("e") * F.col("e")).alias("square"))
    r = sums.withColumn("lag1_autocorrelation", F.coalesce(F.try_divide("cross", "square"), F.lit(0.0)))
    rest = 1 - F.col("lag1_autocorrelation") * F.col("lag1_autocorrelation")
    usable = (F.col("t") >= 4) & (rest >= 1e-15)
    out = r.withColumn("carry_over_t", F.when(usable, F.col("lag1_autocorrelation") * F.sqrt((F.col("t") - 2) / rest)))
    return out.select(*keys, "lag1_autocorrelation", "carry_over_t", F.coalesce(D.t_p_value(F.col("carry_over_t"), (F.col("t") - 2).cast("double")), F.lit(1.0)).alias("carry_over_p"))


def switchback_randomization(series: DataFrame, keys: list[str], permutations: int = 2000, blocks: int = 8, seed: int = 3) -> DataFrame:
    """Permutation p of the arm contrast: blocks of permutations are tasks, exceedances are summed.

    All assignments are tried where there are no more than ``permutations`` of them, and p is
    exact; otherwise that many are drawn.
    """
    block_rows = series.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", "arm", "value"))).alias("rows"))
    ids = series.sparkSession.range(blocks).select(F.col("id").cast("int").alias("chunk"))
    each = permutations // blocks

    def permuted(batches):
        for batch in batches:
            out = []
            for rows, chunk, *key in batch[["rows", "chunk", *keys]].itertuples(index=False):
                arm, value = np.array([r["arm"] for r in rows], float), np.array([r["value"] for r in rows], float)
                n = int(arm.sum())
                exact = math.comb(len(arm), n) <= permutations
                if exact:
                    picks = [list(p) for p in itertools.islice(itertools.combinations(range(len(arm)), n), int(chunk), None, blocks)]
                    tried = np.zeros((len(picks), len(arm)))
                    for row, pick in enumerate(picks):
                        tried[row, pick] = 1
                else:
                    tried = np.random.default_rng([seed, int(chunk)]).permuted(np.tile(arm, (each, 1)), axis=1)
                contrast = lambda a: (a @ value) / max(n, 1) - ((1 - a) @ value) / max(len(arm) - n, 1)
                out.append([*key, int((np.abs(contrast(tried)) >= abs(contrast(arm)) - 1e-12).sum()), len(tried), exact])
            yield pd.DataFrame(out, columns=[*keys, "extreme", "draws", "exact"])

    kinds = ", ".join(f"{k} {t}" for k, t in series.dtypes if k in keys)
    counts = block_rows.crossJoin(F.broadcast(ids)).repartition(blocks, "chunk").mapInPandas(permuted, f"{kinds}, extreme long, draws long, exact boolean")
    own = F.when(F.col("exact"), 0).otherwise(1)  # a drawn test counts the assignment itself
    summed = counts.groupBy(*keys, "exact").agg(F.sum("extreme").alias("extreme"), F.sum("draws").alias("draws"))
    return summed.select(*keys, ((own + F.col("extreme")) / (own + F.col("draws"))).alias("p_value"), "draws", "exact")


def _simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    shift = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
    return np.maximum(v - shift[np.flatnonzero(u > shift)[-1]], 0)


def simplex_fit(donors: np.ndarray, target: np.ndarray, passes: int = 3000) -> np.ndarray:
    """Non-negative weights that sum to 1, by accelerated projected gradient: donors is (periods, units)."""
    k = donors.shape[1]
    w = z = np.full(k, 1 / k)
    gram, linear = donors.T @ donors, donors.T @ target
    step = 1 / max(np.linalg.eigvalsh(gram)[-1], 1e-12)
    momentum = 1.0
    for _ in range(passes):
        new = _simplex(z - step * (gram @ z - linear))
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        z = new + (momentum - 1) / after * (new - w)
        if np.abs(new - w).max() < 1e-12:
            w = new
            break
        w, momentum = new, after
    return w


def _regression(donors: np.ndarray, target: np.ndarray, ridge: float = 1e-3) -> tuple[float, np.ndarray]:
    """Intercept and a coefficient per donor, with a small ridge on the coefficients, about the means."""
    x, y = donors - donors.mean(0), target - target.mean()
    gram = x.T @ x
    beta = np.linalg.solve(gram + max(ridge * np.trace(gram) / len(gram), 1e-12) * np.eye(len(gram)), x.T @ y)
    return float(target.mean() - donors.mean(0) @ beta), beta


def _trend_forecast(y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(forecast, its variance, deviation of one-step errors) of a local linear trend filtered over y."""
    var = max(float(np.var(y)), 1e-9)
    move, noise = np.array([[1.0, 1.0], [0.0, 1.0]]), np.diag([0.01 * var, 1e-6 * var])
    state, cov, errors = np.array([y[0], 0.0]), np.diag([var, 1e-3 * var]), []
    for value in y[1:]:
        state, cov = move @ state, move @ cov @ move.T + noise
        errors.append(value - state[0])
        gain = cov[:, 0] / (cov[0, 0] + var)
        state, cov = state + gain * errors[-1], cov - np.outer(gain, cov[0])
    ahead, spread = [], []
    for _ in range(horizon):
        state, cov = move @ state, move @ cov @ move.T + noise
        ahead.append(state[0])
        spread.append(cov[0, 0] + var)
    return np.array(ahead), np.array(spread), float(np.sqrt(np.mean(np.square(errors)))) if errors else 0.0


def trend_effect(pre: np.ndarray, post: np.ndarray, target_pre: np.ndarray, target_post: np.ndarray, alpha: float = 0.05) -> tuple[float, float, float, float]:
    """(effect, interval, p) against a counterfactual of donors and trend.

    The target is regressed on its donors before the treatment, so shocks that all units share
    are no effect; a local linear trend follows what is left. The interval comes from the
    forecast's variance, p from the one-step errors before the treatment.
    """
    intercept, beta = _regression(pre, target_pre)
    fit = lambda x: intercept + x @ beta
    ahead, spread, error = _trend_forecast(target_pre - fit(pre), len(target_post))
    effect = float((target_post - fit(post) - ahead).mean())
    half = NormalDist().inv_cdf(1 - alpha / 2) * float(np.sqrt(spread.sum())) / len(target_post)
    p = math.erfc(abs(effect) / error / math.sqrt(2)) if error > 1e-14 else 1.0
    return effect, effect - half, effect + half, p


def _deviation(values: np.ndarray, least: int = 2) -> float:
    return float(np.std(values, ddof=1)) if len(values) >= least else 0.0


def counterfactual_effect(method: str, pre: np.ndarray, post: np.ndarray, target_pre: np.ndarray, target_post: np.ndarray) -> tuple[float, float]:
    """(mean post-period effect, standard error) of one unit against a counterfactual from its donors.

    The error of the classic form comes from placebos, and here is that of the target before
    the treatment, for want of donors. The augmented form has the deviation of its residuals
    before the treatment; the difference form leaves out each period after it in turn, with
    the weights as they are, and has half the effect where there is one such period.
    """
    if method == "did":
        times = simplex_fit(pre.T, post.mean(0))
        before, own = times @ pre, float(times @ target_pre)
        units = simplex_fit(before[None, :], np.array([own]))
        gaps = target_post - own - (post - before) @ units
        att, m = float(gaps.mean()), len(gaps)
        if m < 2:
            return att, 0.5 * max(abs(att), 1e-3)
        without = (gaps.sum() - gaps) / (m - 1)
        return att, float(np.sqrt((m - 1) / m * ((without - without.mean()) ** 2).sum()))
    w = simplex_fit(pre, target_pre)
    gap = target_post - post @ w
    if method == "classic":
        return float(gap.mean()), float(np.std(target_pre))
    if method == "augmented":
        rest = target_pre - pre @ w
        gram = pre.T @ pre
        ridge = 0.1 * np.trace(gram) / len(pre) / pre.shape[1]
        beta = np.linalg.solve(gram + max(ridge, 1e-12) * np.eye(pre.shape[1]), pre.T @ rest)
        return float((gap + post @ beta).mean()), _deviation(rest)
    raise ValueError(f"no such method: {method!r}")


def trend_counterfactual(panel: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Effect, interval and p per experiment by ``trend_effect``; the panel is that of ``synthetic_control``.

    An experiment's panel of aggregates, units × periods, is one group. Periods that a unit
    lacks are left out; without donors, or without both kinds of periods, there is no row.
    """

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        wide = group.pivot_table(index="period", columns="unit_id", values="value").dropna()
        after = group.groupby("period")["is_post"].max().reindex(wide.index).to_numpy(bool)
        treated = group.loc[group["is_treated_unit"], "unit_id"].unique()
        donors = [c for c in wide.columns if c not in treated]
        if not donors or len(treated) == 0 or not after.any() or after.sum() > len(after) - 2:
            return pd.DataFrame({"experiment_id": np.zeros(0, object), "att": np.zeros(0), "ci_lower": np.zeros(0), "ci_upper": np.zeros(0), "p_value": np.zeros(0)}).astype({"experiment_id": object})
        y, x = wide[treated[0]].to_numpy(float), wide[donors].to_numpy(float)
        return pd.DataFrame([[group["experiment_id"].iloc[0], *trend_effect(x[~after], x[after], y[~after], y[after], alpha)]], columns=["experiment_id", "att", "ci_lower", "ci_upper", "p_value"])

    return panel.groupBy("experiment_id").applyInPandas(fit, "experiment_id string, att double, ci_lower double, ci_upper double, p_value double")


#: Tasks that share an experiment's placebo fits; the panel goes to each of them.
PLACEBO_SLICES = 16


def synthetic_control(panel: DataFrame, method: str = "classic", alpha: float = 0.05) -> DataFrame:
    """ATT, error, interval and placebo p per experiment from (experiment_id, unit_id, period, value, is_treated_unit, is_post).

    Every unit takes its turn as target against the donors, and every donor its turn out of
    the treated unit's donors. Both are dealt by a hash of the unit to ``PLACEBO_SLICES`` tasks
    an experiment, each with the panel (units × periods of aggregates) once, so rows grow with
    the units and not with their square; periods that a unit lacks are left out. p is
    (1 + #{|att_k| ≥ |att|}) / (1 + donors), and 1 with fewer than two donors. The interval is
    normal, with the error that ``counterfactual_effect`` names for the method, the classic
    form's from the deviation of its placebos; ``jackknife_se`` is that of leaving out donors.
    """
    units = F.size(F.collect_set("unit_id").over(Window.partitionBy("experiment_id")))
    seen = F.size(F.collect_set("unit_id").over(Window.partitionBy("experiment_id", "period")))
    panel = panel.withColumns({"units": units, "seen": seen}).filter("units = seen").drop("units", "seen")
    series = panel.groupBy("experiment_id", "unit_id", "is_treated_unit").agg(F.sort_array(F.collect_list(F.struct("period", "is_post", "value"))).alias("rows"))
    own = F.pmod(F.xxhash64("unit_id"), F.lit(PLACEBO_SLICES)).cast("int")
    jobs = series.withColumn("own", own).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(PLACEBO_SLICES - 1))))
    # a set number, which adaptive execution leaves apart: rows are few, but fits are long
    jobs = jobs.repartition(int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")), "experiment_id", "slice")
    placebo_method = method if method in ("classic", "did") else "classic"

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("unit_id").reset_index(drop=True)
        donor = ~group["is_treated_unit"].to_numpy(bool)
        values = np.array([[r["value"] for r in rows] for rows in group["rows"]], float).T  # periods × units
        after = np.array([bool(r["is_post"]) for r in group["rows"].iloc[0]])
        name, out = group["experiment_id"].iloc[0], []
        if not after.any() or after.all():
            return pd.DataFrame(out, columns=["experiment_id", "target", "kind", "att", "se"])

        def effect(target: int, others: np.ndarray, how: str) -> tuple[float, float]:
            x, y = values[:, others], values[:, target]
            return counterfactual_effect(how, x[~after], x[after], y[~after], y[after])

        for at in np.flatnonzero(group["own"] == group["slice"]):
            others = donor.copy()
            others[at] = False
            if not others.any():
                continue
            if not donor[at]:
                out.append((name, str(group["unit_id"].iloc[at]), "treated", *effect(at, others, method)))
                continue
            out.append((name, str(group["unit_id"].iloc[at]), "placebo", *effect(at, others, placebo_method)))
            out += [(name, str(group["unit_id"].iloc[t]), "without", effect(t, others, method)[0], 0.0) for t in np.flatnonzero(~donor)]
        return pd.DataFrame(out, columns=["experiment_id", "target", "kind", "att", "se"])

    effects = jobs.groupBy("experiment_id", "slice").applyInPandas(fit, "experiment_id string, target string, kind string, att double, se double")
    real = effects.filter("kind = 'treated'").select("experiment_id", "target", "att", "se")
    placebos = effects.filter("kind = 'placebo'").select("experiment_id", F.col("att").alias("placebo"))
    without = effects.filter("kind = 'without'").groupBy("experiment_id", "target").agg(((F.count("*") - 1) * F.sqrt(F.var_samp("att") / F.count("*"))).alias("jackknife_se"))
    out = real.join(placebos, "experiment_id", "left").groupBy("experiment_id", "target", "att", "se").agg(F.count("placebo").alias("donors"), F.sum((F.abs("placebo") >= F.abs("att")).cast("int")).alias("extreme"), F.stddev_samp("placebo").alias("spread"))
    error = F.when(F.col("donors") >= 2, F.col("spread")).otherwise(F.col("se")) if method == "classic" else F.col("se")
    half = NormalDist().inv_cdf(1 - alpha / 2) * F.col("se")
    named = out.join(without, ["experiment_id", "target"], "left").withColumn("se", F.greatest(error, F.lit(1e-10)))
    p = F.when(F.col("donors") < 2, 1.0).otherwise((1 + F.col("extreme")) / (1 + F.col("donors")))
    return named.select("experiment_id", "att", "se", (F.col("att") - half).alias("ci_lower"), (F.col("att") + half).alias("ci_upper"), "donors", p.alias("p_value"), "jackknife_se")
