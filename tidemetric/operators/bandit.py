"""Bandit statistics as jobs: posteriors, arm states, slate attribution, off-policy values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemetric.operators.inference import ROWS_PER_RANGE
from tidemetric.sources.store import kept


def thompson_posteriors(rewards: DataFrame) -> DataFrame:
    """α = 1 + Σr and β = 1 + Σ(1 - r) per experiment and arm; sums commute, so order is free."""
    return rewards.groupBy("experiment_id", "arm_id").agg((1 + F.sum("reward")).alias("alpha"), (1 + F.sum(1 - F.col("reward"))).alias("beta"), F.count("*").alias("pulls"))


def linucb_sums(rewards: DataFrame) -> DataFrame:
    """Long form of arm states: (arm, i, j, a) with A = I + Σ x xᵀ, and b = Σ r x beside the diagonal."""
    x = rewards.select("experiment_id", "arm_id", "reward", F.posexplode("context").alias("i", "xi"), "context")
    pairs = x.select("experiment_id", "arm_id", "reward", "i", "xi", F.posexplode("context").alias("j", "xj"))
    sums = pairs.groupBy("experiment_id", "arm_id", "i", "j").agg(F.sum(F.col("xi") * F.col("xj")).alias("s"), F.sum(F.when(F.col("i") == F.col("j"), F.col("reward") * F.col("xi"))).alias("b"))
    return sums.select("experiment_id", "arm_id", "i", "j", (F.col("s") + (F.col("i") == F.col("j")).cast("double")).alias("a"), "b")


def linucb_weights(sums: DataFrame) -> DataFrame:
    """θ = A⁻¹ b and A⁻¹ per arm: a d × d system each, solved in its own group."""

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        d = int(group["i"].max()) + 1
        a, b = np.eye(d), np.zeros(d)
        a[group["i"], group["j"]] = group["a"]
        diagonal = group[group["i"] == group["j"]]
        b[diagonal["i"]] = diagonal["b"]
        inverse = np.linalg.inv(a)
        return pd.DataFrame({"experiment_id": [group["experiment_id"].iloc[0]], "arm_id": [group["arm_id"].iloc[0]], "theta": [(inverse @ b).tolist()], "inverse": [inverse.ravel().tolist()]})

    return sums.groupBy("experiment_id", "arm_id").applyInPandas(solve, "experiment_id string, arm_id int, theta array<double>, inverse array<double>")


def ucb_scores(contexts: DataFrame, weights: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Score θ·x + α √(xᵀ A⁻¹ x) of every context row and arm. Arms are few; JVM-side throughout."""
    rows = contexts.join(weights, "experiment_id")
    dot = F.aggregate(F.zip_with("theta", "context", lambda t, x: t * x), F.lit(0.0), lambda s, v: s + v)
    d = F.size("context")
    spread = F.aggregate(
        F.transform("inverse", lambda v, k: v * F.get("context", F.floor(k / d).cast("int")) * F.get("context", (k % d).cast("int"))), F.lit(0.0), lambda s, v: s + v
    )
    return rows.select(*contexts.columns, "arm_id", (dot + alpha * F.sqrt(F.greatest(F.lit(0.0), spread))).alias("score"))


def best_arm(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Arm of the highest mean score per key, ties to the smaller arm."""
    means = scored.groupBy(*keys, "arm_id").agg(F.avg("score").alias("score"))
    return means.groupBy(*keys).agg(F.max_by("arm_id", F.struct("score", -F.col("arm_id"))).alias("arm_id"), F.max("score").alias("score"))


def selection_probabilities(posteriors: DataFrame, draws: int = 1000, seed: int = 7) -> DataFrame:
    """Share of posterior draws in which each arm is best; an arm keeps the weight of one draw at least.

    Experiments are groups of a few arms; draws are made in one vectorised call per group.
    """

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("arm_id")
        rng = np.random.default_rng([seed, *group["experiment_id"].iloc[0].encode()])
        best = rng.beta(group["alpha"].to_numpy(), group["beta"].to_numpy(), (draws, len(group))).argmax(1)
        wins = np.maximum(np.bincount(best, minlength=len(group)), 1)
        return pd.DataFrame({"experiment_id": group["experiment_id"], "arm_id": group["arm_id"], "probability": wins / wins.sum()})

    return posteriors.groupBy("experiment_id").applyInPandas(draw, "experiment_id string, arm_id int, probability double")


def slate_rewards(slates: DataFrame, scheme: str) -> DataFrame:
    """(slate_id, position, item, reward) from slates (slate_id, items, clicked, reward); clicked is null without a click.

    clicked_only: the clicked slot. position_weighted: the clicked slot over (position + 1).
    leave_one_out: slots before the click get 0, the click its reward, later slots nothing; no click gives all 0.
    """
    rows = slates.select("slate_id", "clicked", "reward", F.posexplode("items").alias("position", "item"))
    hit = F.coalesce(F.col("position") == F.col("clicked"), F.lit(False))
    if scheme == "clicked_only":
        return rows.select("slate_id", "position", "item", F.when(hit, F.col("reward")).otherwise(0.0).alias("reward"))
    if scheme == "position_weighted":
        return rows.select("slate_id", "position", "item", F.when(hit, F.col("reward") / (F.col("position") + 1)).otherwise(0.0).alias("reward"))
    if scheme == "leave_one_out":
        kept = rows.filter(F.col("clicked").isNull() | (F.col("position") <= F.col("clicked")))
        return kept.select("slate_id", "position", "item", F.when(hit, F.col("reward")).otherwise(0.0).alias("reward"))
    raise ValueError(f"no such scheme: {scheme!r}")


def debiased(reward: Column, position: Column, model: str = "none", gamma: float = 0.85, examination: dict[int, float] | None = None) -> Column:
    """Reward over the chance that the position was looked at, clamped to [0, 1]."""
    if model == "none":
        seen = F.lit(1.0)
    elif model == "cascade":
        seen = F.pow(F.lit(gamma), position)
    elif model == "examination":
        seen = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in examination.items() for v in kv]), position), F.lit(1.0))
    else:
        raise ValueError(f"no such model: {model!r}")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(reward, seen), F.lit(0.0))))


def lips_estimate(log: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of reward / propensity; rows of zero propensity add nothing but are counted."""
    weighted = F.when(F.col("propensity") > 0, F.col("reward") / F.col("propensity")).otherwise(0.0)
    return log.groupBy(*keys).agg((F.sum(weighted) / F.count("*")).alias("value"), F.count("*").alias("n"))


def ema_normalised(rewards: DataFrame, keys: list[str], order: str, rate: float = 0.01) -> DataFrame:
    """Running mean and variance by exponential moving average in order, and the z of the last reward.

    Starts at mean 0 and variance 1: mean += rate·Δ and variance = (1 - rate)·(variance + rate·Δ²)
    with Δ against the old mean. Mean and second moment are both linear in their start and
    variance is their difference, so ranges of the order give a decay and two weighted sums
    each, and the few ranges of a key are combined by the decay after them. z uses the
    updated state.
    """
    keep = 1 - rate
    parts = max(1, -(-rewards.count() // ROWS_PER_RANGE))
    dealt = rewards.select(*keys, order, "reward").repartitionByRange(parts, *keys, order).withColumn("range", F.spark_partition_id())
    back = Window.partitionBy(*keys, "range").orderBy(F.col(order).desc(), F.col("reward").desc())
    aged = dealt.withColumn("weight", rate * F.pow(F.lit(keep), F.row_number().over(back) - 1))
    sums = aged.groupBy(*keys, "range").agg(F.count("*").alias("n"), F.sum(F.col("weight") * F.col("reward")).alias("a"), F.sum(F.col("weight") * F.col("reward") * F.col("reward")).alias("b"), F.max_by("reward", F.struct(order, "reward")).alias("last"))
    later = Window.partitionBy(*keys).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("decay", F.pow(F.lit(keep), F.coalesce(F.sum("n").over(later), F.lit(0))))
    ends = placed.groupBy(*keys).agg(F.sum(F.col("a") * F.col("decay")).alias("mean"), (F.pow(F.lit(keep), F.sum("n")) + F.sum(F.col("b") * F.col("decay"))).alias("second"), F.max_by("last", "range").alias("last"))
    out = ends.withColumn("variance", F.greatest(F.col("second") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return out.select(*keys, "mean", "variance", ((F.col("last") - F.col("mean")) / F.sqrt(F.greatest("variance", F.lit(1e-12)))).alias("z"))


def ema_path(rewards: DataFrame, keys: list[str], order: str, rate: float = 0.01) -> DataFrame:
    """Every reward with its z by ``ema_normalised`` as of then, and the ideal: the largest z so far, 0 at least.

    Prefixes of the moving sums come in two levels. Spark deals rows into ranges of the order;
    within a block of a range, as long as decays fit a double, they are window sums, and the
    state at a block's start is folded from the blocks before it as far as their decay counts
    at all. Ideals are running maxima within blocks, and over the blocks before.
    """
    keep = 1 - rate
    length = max(1, int(300 / -math.log(keep)))  # decays stay above e^-300
    parts = max(1, rewards.count() // (10 * length))
    dealt = rewards.select(*keys, order, "reward").repartitionByRange(parts, *keys, order, "reward").withColumn("__range", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(order, "reward")) - 1
    rows = kept(dealt.withColumn("__place", place).withColumns({"__block": F.floor(F.col("__place") / length), "__at": F.col("__place") % length + 1}), "ema-rows")
    so_far = Window.partitionBy(*keys, "__range", "__block").orderBy("__at")
    grown = lambda x: F.pow(F.lit(keep), F.col("__at")) * F.sum(rate * x * F.pow(F.lit(keep), -F.col("__at"))).over(so_far)
    local = rows.withColumns({"first": grown(F.col("reward")), "second": grown(F.col("reward") * F.col("reward"))})
    blocks = local.groupBy(*keys, "__range", "__block").agg(F.max_by(F.struct("__at", "first", "second"), "__at").alias("end"))
    before = Window.partitionBy(*keys).orderBy("__range", "__block")
    near = F.collect_list("end").over(before.rowsBetween(-64, -1))  # 64 blocks: at least six of full length, or all there are
    start = F.struct(F.lit(0.0).alias("first"), F.lit(1.0).alias("second"))
    carry = F.aggregate(near, start, lambda s, b: F.struct((s["first"] * F.pow(F.lit(keep), b["__at"]) + b["first"]).alias("first"), (s["second"] * F.pow(F.lit(keep), b["__at"]) + b["second"]).alias("second")))
    carried = blocks.select(*keys, "__range", "__block", carry.alias("carry"))
    decay = F.pow(F.lit(keep), F.col("__at"))
    state = local.join(carried, [*keys, "__range", "__block"]).withColumns({"mean": F.col("first") + decay * F.col("carry.first"), "square": F.col("second") + decay * F.col("carry.second")})
    z = (F.col("reward") - F.col("mean")) / F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(1e-8)))
    scored = kept(state.select(*keys, order, "reward", "__range", "__block", "__at", z.alias("z")), "ema-z")
    tops = scored.groupBy(*keys, "__range", "__block").agg(F.max("z").alias("top"))
    above = tops.select(*keys, "__range", "__block", F.greatest(F.coalesce(F.max("top").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), F.lit(0.0)).alias("above"))
    ideal = F.greatest("above", F.max("z").over(so_far))
    return scored.join(above, [*keys, "__range", "__block"]).select(*keys, order, "reward", "z", ideal.alias("ideal"))


def composed(z: dict[str, Column], scheme: str, weights: dict[str, float], ideal: dict[str, Column] | None = None, floors: dict[str, float] | None = None) -> Column:
    """One reward of several normalised ones: weighted sum, epsilon-constraint or Tchebycheff."""
    total = sum((F.lit(w) * z[m] for m, w in weights.items()), F.lit(0.0))
    if scheme == "weighted":
        return total
    if scheme == "epsilon_constraint":
        short = sum((F.greatest(F.lit(0.0), F.lit(f) - z[m]) for m, f in (floors or {}).items()), F.lit(0.0))
        return total - 10.0 * short
    if scheme == "tchebycheff":
        return -F.greatest(*[F.lit(w) * F.abs((ideal or {}).get(m, F.lit(0.0)) - z[m]) for m, w in weights.items()], F.lit(0.0))
    raise ValueError(f"no such scheme: {scheme!r}")


def allocation_shares(selections: DataFrame, order: str, rate: float, arms: list[int], low: float, high: float) -> DataFrame:
    """EMA of selections per arm from equal shares on, in order, and whether it keeps within [low, high].

    The share is linear in its start, so rows are dealt by ranges of the order: each range gives
    its decay and its weighted sum per arm, and the few ranges are combined by the decay after them.
    """
    keep = 1 - rate
    dealt = selections.select("experiment_id", order, "arm_id").repartitionByRange(max(1, -(-selections.count() // ROWS_PER_RANGE)), "experiment_id", order).withColumn("range", F.spark_partition_id())
    back = Window.partitionBy("experiment_id", "range").orderBy(F.col(order).desc(), F.col("arm_id").desc())
    aged = dealt.withColumn("weight", rate * F.pow(F.lit(keep), F.row_number().over(back) - 1))
    sums = [F.struct(F.lit(a).alias("arm_id"), F.coalesce(F.sum(F.when(F.col("arm_id") == a, F.col("weight"))), F.lit(0.0)).alias("sum")) for a in arms]
    ranges = aged.groupBy("experiment_id", "range").agg(F.count("*").alias("n"), F.array(*sums).alias("sums"))
    later = Window.partitionBy("experiment_id").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("decay", F.pow(F.lit(keep), F.coalesce(F.sum("n").over(later), F.lit(0))))
    each = placed.select("experiment_id", "n", "decay", F.explode("sums").alias("arm"))
    share = F.pow(F.lit(keep), F.sum("n")) / len(arms) + F.sum(F.col("arm.sum") * F.col("decay"))
    shares = each.groupBy("experiment_id", F.col("arm.arm_id").alias("arm_id")).agg(share.alias("share"))
    return shares.withColumn("in_bounds", F.col("share").between(low, high))


def daily_shares(selections: DataFrame, day: str) -> DataFrame:
    """Plain share of selections per day and arm."""
    n = selections.groupBy("experiment_id", day, "arm_id").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("experiment_id", day)))


def _draft(lists: dict[str, list], kind: str, length: int, rng: np.random.Generator, sharpness: float) -> tuple[list, list]:
    names, picked, owner = sorted(lists), [], []
    won = dict.fromkeys(names, 0)
    while len(picked) < length:
        open_to = [a for a in names if any(i not in picked for i in lists[a])]
        if not open_to:
            break
        if kind == "optimized":
            chance = np.array([sum(np.exp(-sharpness * r) for r, i in enumerate(lists[a]) if i not in picked) for a in open_to])
            team = open_to[rng.choice(len(open_to), p=chance / chance.sum())]
        else:
            fewest = min(won[a] for a in open_to)
            team = rng.choice([a for a in open_to if won[a] == fewest])
        picked.append(next(i for i in lists[team] if i not in picked))
        owner.append(str(team))
        won[team] += 1
    return picked, owner


def _drafted(kind: str, length: int, seed: int, sharpness: float):
    """Lists of all users of a batch; a user whose rows run on into the next batch waits for it."""

    def lists_of(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for user, group in rows.groupby("user_id", sort=False):
            rng = np.random.default_rng([seed, int(user) & 0xFFFFFFFF])
            picked, owner = _draft({a: part["item"].tolist() for a, part in group.groupby("algorithm", sort=False)}, kind, length, rng, sharpness)
            out += [(int(user), at, item, team) for at, (item, team) in enumerate(zip(picked, owner, strict=True))]
        return pd.DataFrame(out, columns=["user_id", "position", "item", "algorithm"])

    def run(batches):
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch])
            last = rows["user_id"].iloc[-1] if len(rows) else None
            held = rows[rows["user_id"] == last]
            yield lists_of(rows[rows["user_id"] != last])
        if held is not None:
            yield lists_of(held)

    return run


def interleave(rankings: DataFrame, kind: str = "team_draft", length: int = 10, seed: int = 0, sharpness: float = 0.5) -> DataFrame:
    """One list per user of two or more rankings (user_id, algorithm, rank, item), with its provenance.

    team_draft and multileave: the team with fewest contributions picks, ties by a generator
    seeded with the user. optimized: teams are drawn by the softmax weight of what they have left.
    Users are dealt to partitions and sorted there; a task reads them batch by batch.
    """
    if kind not in ("team_draft", "multileave", "optimized"):
        raise ValueError(f"no such kind: {kind!r}")
    ordered = rankings.filter("user_id is not null").repartition("user_id").sortWithinPartitions("user_id", "algorithm", "rank", "item")
    return ordered.mapInPandas(_drafted(kind, length, seed, sharpness), "user_id long, position int, item int, algorithm string")


def mad_e_process(rewards: DataFrame, keys: list[str], order: list[str], sigma_sq: float, alpha: float = 0.05) -> DataFrame:
    """Growth-rate e-value on the rows whose arm was drawn uniformly (``uniform``)."""
    from tidemetric.operators.inference import e_value_grow

    return e_value_grow(rewards.filter("uniform"), keys, order, sigma_sq, alpha)
