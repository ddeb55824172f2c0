"""Instrumental variables, user trajectories and doubly robust off-policy values."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kfold_iv(rows: DataFrame, folds: int, fold: Column) -> DataFrame:
    """Cross-fitted first stage: surrogate s on assignment z off-fold, then y on the prediction ŝ.

    Reads z (0/1), s, y. γ = cov(ŝ, y) / cov(ŝ, s); also the OLS slope, an HC0 error and the
    first-stage F with its strength. Off-fold sums are the total less the fold's own.
    """
    named = rows.withColumn("fold", fold)
    sums = named.groupBy("fold").agg(*[F.sum(e).alias(a) for a, e in (("n", F.lit(1.0)), ("z1", F.col("z").cast("double")), ("zz", (F.col("z") * F.col("z")).cast("double")), ("s1", F.col("s")), ("zs", F.col("z") * F.col("s")))])
    every = Window.partitionBy()
    rest = sums.select("fold", *[(F.sum(c).over(every) - F.col(c)).alias(c) for c in ("n", "z1", "zz", "s1", "zs")])
    slope = F.try_divide(F.col("n") * F.col("zs") - F.col("z1") * F.col("s1"), F.col("n") * F.col("zz") - F.col("z1") * F.col("z1"))
    fit = rest.withColumn("a", F.coalesce(slope, F.lit(0.0))).withColumn("b", F.try_divide(F.col("s1") - F.col("a") * F.col("z1"), F.col("n"))).select("fold", "a", "b")
    scored = named.join(F.broadcast(fit), "fold").withColumn("hat", F.col("b") + F.col("a") * F.col("z"))
    means = scored.agg(F.avg("hat").alias("mh"), F.avg("s").alias("ms"), F.avg("y").alias("my"))
    c = scored.crossJoin(means).withColumns({"dh": F.col("hat") - F.col("mh"), "ds": F.col("s") - F.col("ms"), "dy": F.col("y") - F.col("my")})
    out = c.agg(
        F.count("*").alias("n"), F.sum(F.col("dh") * F.col("dy")).alias("hy"), F.sum(F.col("dh") * F.col("ds")).alias("hs"), F.sum(F.col("ds") * F.col("dy")).alias("sy"), F.sum(F.col("ds") * F.col("ds")).alias("ss"),
        F.sum(F.col("dh") * F.col("dh") * F.col("dy") * F.col("dy")).alias("yy"), F.sum(F.col("dh") * F.col("dh") * F.col("dy") * F.col("ds")).alias("ys"), F.sum(F.col("dh") * F.col("dh") * F.col("ds") * F.col("ds")).alias("dd"),
        F.corr("z", "s").alias("r"),
    )
    gamma = F.try_divide("hy", "hs")
    out = out.withColumn("gamma", gamma).withColumns({
        "ols_slope": F.try_divide("sy", "ss"), "se": F.sqrt(F.greatest(F.lit(0.0), F.col("yy") - 2 * F.col("gamma") * F.col("ys") + F.col("gamma") * F.col("gamma") * F.col("dd"))) / F.abs("hs"),
        "first_stage_f": F.try_divide(F.col("r") * F.col("r") * (F.col("n") - 2), 1 - F.col("r") * F.col("r")),
    })
    strength = F.when(F.col("first_stage_f") >= 10, "strong").when(F.col("first_stage_f") >= 5, "moderate").otherwise("weak")
    return out.select("n", "gamma", "se", "ols_slope", "first_stage_f", strength.alias("strength"))


def user_trajectories(events: DataFrame, day: str, action: Column, reward: Column, probability: Column) -> DataFrame:
    """Steps per user and day: state (events, mean value), action, reward, next state, logging probability."""
    daily = events.groupBy("experiment_id", "user_id", day).agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("v"), F.max(action).alias("action_id"), F.sum(reward).alias("reward"), F.max(probability).alias("logging_probability"))
    own = Window.partitionBy("experiment_id", "user_id").orderBy(day)
    state = F.array("n", "v")
    return daily.withColumn("state_features", state).select(
        "experiment_id", "user_id", F.row_number().over(own).alias("trajectory_step"), "state_features", "action_id", "reward", F.lead("state_features").over(own).alias("next_state_features"), "logging_probability"
    )


def clipped_ratios(steps: DataFrame, keys: list[str], order: str, ratio: str, clip: float) -> DataFrame:
    """``steps`` with ``rho``: the product of ratios so far, held to ``clip`` after each step, as plain windows.

    What clipping takes off stays off, so with P the plain product rho is
    P · min(1, clip / the largest P so far). A ratio that is null or not above 0 ends it at 0.
    """
    own = Window.partitionBy(*keys).orderBy(order)
    r = F.col(ratio)
    logs = steps.withColumns({"__log": F.coalesce(F.sum(F.ln(F.when(r > 0, r))).over(own), F.lit(0.0)), "__dead": F.max(F.coalesce(r <= 0, F.lit(True)).cast("int")).over(own)})
    top = F.max("__log").over(own)
    rho = F.when(F.col("__dead") == 1, 0.0).otherwise(F.exp(F.col("__log") + F.least(F.lit(0.0), F.lit(math.log(clip)) - top)))
    return logs.withColumn("rho", rho).drop("__log", "__dead")


def _dot(beta: np.ndarray, state: Column, action: Column) -> Column:
    terms = [F.lit(float(beta[0]))] + [F.lit(float(b)) * F.get(state, F.lit(i)) for i, b in enumerate(beta[1:-1])] + [F.lit(float(beta[-1])) * action]
    return reduce(lambda a, b: a + b, terms)


def dr_off_policy(steps: DataFrame, horizon: int, dims: int, gamma: float, clip: float, target: Column) -> DataFrame:
    """Doubly robust, direct and importance-weighted value of a target policy over trajectories.

    ``steps`` has user_id, trajectory_step, state_features, action_id (0/1), reward and
    logging_probability; ``target`` is the target policy's probability of action 1. Q is linear in (1, state,
    action) per step, fitted backwards: each step is one aggregation to normal equations of
    (dims + 2)² sums, solved on the driver. The clipped ratio feeds the next step, so the
    last pass folds each user's ordered steps.
    """
    spark = steps.sparkSession
    prob = F.when(F.col("action_id") == 1, target).otherwise(1 - target)
    base = steps.filter(F.col("trajectory_step") <= horizon).select(
        "user_id", F.col("trajectory_step").alias("t"), F.col("state_features").alias("x"), F.col("action_id").cast("double").alias("a"), "reward", target.alias("pi"), F.try_divide(prob, F.col("logging_probability")).alias("ratio")
    )
    features = [F.lit(1.0), *[F.get("x", F.lit(i)) for i in range(dims)], F.col("a")]
    k = len(features)
    q = {horizon + 1: np.zeros(k)}
    own = Window.partitionBy("user_id").orderBy("t")
    ahead = base.withColumns({"nx": F.lead("x").over(own), "npi": F.lead("pi").over(own)})
    for t in range(horizon, 0, -1):
        beta = q[t + 1]
        v = F.when(F.col("nx").isNotNull(), F.col("npi") * _dot(beta, F.col("nx"), F.lit(1.0)) + (1 - F.col("npi")) * _dot(beta, F.col("nx"), F.lit(0.0))).otherwise(0.0)
        y = F.col("reward") + gamma * v
        sums = [F.sum(features[i] * features[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(features[i] * y).alias(f"y{i}") for i in range(k)]
        row = ahead.filter(F.col("t") == t).agg(F.count("*").alias("n"), *sums).first()  # one row of sums
        q[t] = np.zeros(k)
        if row["n"] >= k:
            gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
            q[t] = np.linalg.solve(gram + 1e-8 * np.eye(k), np.array([row[f"y{i}"] for i in range(k)], float))
    table = spark.createDataFrame([(t, [float(b) for b in beta]) for t, beta in q.items() if t <= horizon], "t int, beta array<double>")
    fold = lambda action: F.get("beta", F.lit(0)) + F.aggregate(F.zip_with(F.slice("beta", 2, dims), "x", lambda b, x: b * x), F.lit(0.0), lambda s, e: s + e) + F.get("beta", F.lit(k - 1)) * action
    scored = ahead.join(F.broadcast(table), "t").withColumns({"qa": fold(F.col("a")), "v": F.col("pi") * fold(F.lit(1.0)) + (1 - F.col("pi")) * fold(F.lit(0.0))})
    chained = scored.withColumn("nv", F.coalesce(F.lead("v").over(Window.partitionBy("user_id").orderBy("t")), F.lit(0.0)))
    paths = chained.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("t", "ratio", "reward", "qa", "v", "nv"))).alias("path"))
    zero = F.struct(F.lit(1.0).alias("rho"), F.lit(1.0).alias("g"), F.lit(0.0).alias("dr"), F.lit(0.0).alias("ips"), F.lit(0).alias("clips"))

    def step(s, e):
        raw = s["rho"] * F.coalesce(e["ratio"], F.lit(0.0))
        rho = F.least(raw, F.lit(float(clip)))
        error = e["reward"] + gamma * e["nv"] - e["qa"]
        return F.struct(
            rho.alias("rho"), (s["g"] * gamma).alias("g"), (s["dr"] + s["g"] * rho * error).alias("dr"), (s["ips"] + s["g"] * rho * e["reward"]).alias("ips"), (s["clips"] + (raw > clip).cast("int")).alias("clips")
        )

    valued = paths.withColumn("s", F.aggregate("path", zero, step)).select("user_id", (F.get("path", F.lit(0))["v"] + F.col("s.dr")).alias("dr"), F.col("s.ips").alias("ips"), F.col("s.rho").alias("rho"), F.col("s.clips").alias("clips"), F.size("path").alias("steps"), F.get("path", F.lit(0))["v"].alias("direct"))
    return valued.agg(
        F.count("*").alias("trajectories"), F.avg("dr").alias("dr_value"), F.avg("direct").alias("direct_value"), F.avg("ips").alias("ips_value"), (F.stddev_samp("dr") / F.sqrt(F.count("*"))).alias("se"),
        F.try_divide(F.sum("rho") * F.sum("rho"), F.sum(F.col("rho") * F.col("rho"))).alias("ess"), (F.sum("clips") / F.sum("steps")).alias("clip_share"),
    )
