import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemetric.functions import distributions as D
from tidemetric.functions.murmur import murmur3
from tidemetric.operators import bandit as B
from tidemetric.operators import catalog as C
from tidemetric.operators import inference as I
from tidemetric.operators import panels as P


def observations(spark, control, treatment, xc=None, xt=None):
    rows = [("m", "control", float(y), float(x)) for y, x in zip(control, xc or control, strict=True)] + [("m", "t1", float(y), float(x)) for y, x in zip(treatment, xt or treatment, strict=True)]
    return spark.createDataFrame(rows, "metric_id string, variant_id string, y double, x double")


def pairs(obs, covariate=False):
    return I.arm_pairs(I.moments(obs, ["metric_id"], covariate), ["metric_id"])


def test_published_distribution_values():
    assert D.t_two_sided([2.228139], [10])[0] == pytest.approx(0.05, abs=1e-6)
    assert D.t_quantile([0.975], [4])[0] == pytest.approx(2.7764451, abs=1e-6)
    assert D.chi_square_tail([3.841459], [1])[0] == pytest.approx(0.05, abs=1e-6)
    assert D.beta_cdf([0.3], [2], [5])[0] == pytest.approx(0.579825, abs=1e-6)
    assert D.sign_test(8, 2) == pytest.approx(0.109375, abs=1e-9)


def test_murmur_vectors():
    assert [int(x) for x in murmur3([b"", b"hello", b"hello, world", b"The quick brown fox jumps over the lazy dog"])] == [0, 0x248BFA47, 0x149BBB7F, 0x2E4FF723]


def test_welch_by_hand(spark):
    c, t = [1, 2, 3, 4, 5], [2, 4, 6, 8, 10, 12]
    got = I.with_t_test(I.welch(pairs(observations(spark, c, t)))).first()
    a, b = np.var(t, ddof=1) / 6, np.var(c, ddof=1) / 5
    df = (a + b) ** 2 / (a**2 / 5 + b**2 / 4)
    assert got["effect"] == pytest.approx(4.0)
    assert got["df"] == pytest.approx(df)
    assert got["p_value"] == pytest.approx(float(D.t_two_sided(4 / math.sqrt(a + b), df)))
    assert got["ci_lower"] < 4 < got["ci_upper"]


def test_arms_of_one_row_drop_out(spark):
    assert I.welch(pairs(observations(spark, [1], [2, 3]))).count() == 0


def test_adjustment_matches_residuals(spark):
    rng = np.random.default_rng(0)
    xc, xt = rng.normal(size=40), rng.normal(size=50)
    yc, yt = 2 * xc + rng.normal(size=40), 1 + 2 * xt + rng.normal(size=50)
    got = I.cuped(pairs(observations(spark, yc, yt, list(xc), list(xt)), True)).first()
    x, y = np.concatenate([xc, xt]), np.concatenate([yc, yt])
    theta = np.cov(x, y)[0, 1] / np.var(x, ddof=1)
    rc, rt = yc - theta * xc, yt - theta * xt
    assert got["theta"] == pytest.approx(theta)
    assert got["effect"] == pytest.approx(rt.mean() - rc.mean())
    assert got["se"] == pytest.approx(math.sqrt(rt.var(ddof=1) / 50 + rc.var(ddof=1) / 40))


def test_constant_covariate_is_left_alone(spark):
    obs = observations(spark, [1, 2, 3], [3, 4, 6], [1, 1, 1], [1, 1, 1])
    assert I.cuped(pairs(obs, True)).count() == 0
    assert I.avlm(pairs(obs, True), 0.5).first()["theta"] == 0.0


def test_benjamini_hochberg_by_hand(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    tests = spark.createDataFrame([("m", str(i), v) for i, v in enumerate(p)], "metric_id string, variant_id string, p_value double")
    got = {r["variant_id"]: r["p_adjusted"] for r in I.benjamini_hochberg(tests, ["metric_id"]).collect()}
    assert [got[str(i)] for i in range(4)] == pytest.approx([0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5])


def test_clustered_error_equals_the_sandwich(spark):
    rng = np.random.default_rng(1)
    rows = [("m", "control" if u % 2 else "t1", u, float(rng.normal() + u % 5)) for u in range(20) for _ in range(1 + u % 4)]
    got = I.clustered(spark.createDataFrame(rows, "metric_id string, variant_id string, user_id int, y double"), ["metric_id"], "user_id").first()
    x = np.array([[1.0, r[1] == "t1"] for r in rows], float)
    y, g = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
    inverse = np.linalg.inv(x.T @ x)
    e = y - x @ (inverse @ x.T @ y)
    meat = sum(np.outer(s := x[g == u].T @ e[g == u], s) for u in set(g))
    n, k = len(y), 20
    assert got["se"] == pytest.approx(math.sqrt((inverse @ meat @ inverse)[1, 1] * k / (k - 1) * n / (n - 2)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=2, max_size=12))
def test_simplex_projection_sums_to_one(v):
    w = P._simplex(np.array(v))
    assert w.sum() == pytest.approx(1.0) and (w >= 0).all()


def test_synthetic_control_finds_an_exact_mixture(spark):
    t = np.arange(20)
    donors = {1: np.sin(t), 2: t / 5.0, 3: np.cos(t / 2)}
    target = 0.3 * donors[1] + 0.7 * donors[2] + np.where(t >= 15, 2.0, 0.0)
    rows = [("e", u, int(p), float(v[p]), u == 0, bool(p >= 15)) for u, v in {0: target, **donors}.items() for p in t]
    panel = spark.createDataFrame(rows, "experiment_id string, unit_id int, period int, value double, is_treated_unit boolean, is_post boolean")
    got = P.synthetic_control(panel).first()
    assert got["att"] == pytest.approx(2.0, abs=0.02) and got["donors"] == 3


def test_empty_observations(spark):
    none = observations(spark, [1, 2], [2, 3]).filter("false")
    assert I.welch(pairs(none)).count() == 0
    assert I.ipw(none.withColumn("p", F.lit(0.5)), ["metric_id"]).count() == 0


def trend_panel(spark, common, effect):
    rng = np.random.default_rng(5)
    base = np.cumsum(rng.normal(0, 1, 40)) + np.where(np.arange(40) >= 30, common, 0.0)
    rows = []
    for unit in range(6):
        y = 100 + 5 * unit + (1 + 0.1 * unit) * base + rng.normal(0, 0.3, 40)
        if unit == 0:
            y[30:] += effect
        rows += [("e", unit, t, float(y[t]), unit == 0, t >= 30) for t in range(40)]
    return spark.createDataFrame(rows, "experiment_id string, unit_id int, period int, value double, is_treated_unit boolean, is_post boolean")


def test_trend_counterfactual_leaves_common_shocks_to_the_donors(spark):
    assert abs(P.trend_counterfactual(trend_panel(spark, 50.0, 0.0)).first()["att"]) < 2
    shock = P.trend_counterfactual(trend_panel(spark, 3.0, 0.0)).first()
    assert abs(shock["att"]) < 1 and shock["p_value"] > 0.05 and shock["ci_lower"] < 0 < shock["ci_upper"]
    real = P.trend_counterfactual(trend_panel(spark, 3.0, 8.0)).first()
    assert real["att"] == pytest.approx(8, abs=2) and real["p_value"] < 0.01 and real["ci_lower"] > 0
    assert P.trend_counterfactual(trend_panel(spark, 0.0, 0.0).filter("unit_id = 0")).count() == 0


def test_few_blocks_are_permuted_exactly(spark):
    values = [5.0, 1.0, 6.0, 2.0, 4.5, 0.5, 7.0, 3.0]
    series = spark.createDataFrame([("e", i, i % 2 ^ 1, v) for i, v in enumerate(values)], "experiment_id string, block long, arm int, value double")
    got = P.switchback_randomization(series, ["experiment_id"]).first()
    own = sum(values[::2]) / 4 - sum(values[1::2]) / 4
    contrasts = [sum(values[i] for i in pick) / 4 - sum(values[i] for i in range(8) if i not in pick) / 4 for pick in itertools.combinations(range(8), 4)]
    assert got["exact"] and got["draws"] == 70
    assert got["p_value"] == pytest.approx(sum(abs(c) >= abs(own) - 1e-12 for c in contrasts) / 70)


def test_earlier_sums_by_ranges_equal_the_running_sums(spark):
    rows = [(f"k{k}", i, float((i * 7 + k) % 5)) for k, n in enumerate((900, 3, 1)) for i in range(n)]
    got = I.earlier_sums(spark.createDataFrame(rows, "k string, at int, y double").repartition(6), ["k"], ["at"], "y").collect()
    assert len(got) == len(rows)
    for r in got:
        earlier = [y for k, at, y in rows if k == r["k"] and at < r["at"]]
        assert (r["n_before"], r["sum_before"]) == (len(earlier), sum(earlier))


def test_step_up_ranks_and_gini_by_ranges_equal_the_plain_ones(spark, monkeypatch):
    """One key with all rows: ranges stay bounded, and results are those of one sorted list."""
    monkeypatch.setattr(I, "ROWS_PER_RANGE", 5_000)
    n = 100_000
    rows = spark.range(n).select(F.lit("all").alias("variant_id"), F.col("id").alias("content_id"), (F.xxhash64("id") % 997).alias("n"), (F.pow(F.rand(4), 3)).alias("p_value"))
    rows = rows.withColumn("n", F.abs("n")).checkpoint()
    sizes = I.ranged(rows, ["variant_id"], ["p_value", "content_id"]).groupBy("range").count().collect()
    assert len(sizes) == n // 5_000 and max(r["count"] for r in sizes) < 2 * 5_000
    plain = rows.toPandas()
    order = np.argsort(plain["p_value"].to_numpy(), kind="stable")
    p = plain["p_value"].to_numpy()[order] * n / np.arange(1, n + 1)
    want = np.minimum(1, np.minimum.accumulate(p[::-1])[::-1])
    got = I.benjamini_hochberg(rows, ["variant_id"], 0.05, tie="content_id").select("content_id", "p_adjusted").toPandas().set_index("content_id")["p_adjusted"]
    assert np.allclose(got.loc[plain["content_id"].to_numpy()[order]].to_numpy(), want)
    values = np.sort(plain["n"].to_numpy(float))
    rank = np.arange(1, n + 1)
    assert C.gini(rows, "content_id").first()["metric_value"] == pytest.approx(2 * (rank * values).sum() / (n * values.sum()) - (n + 1) / n)
    place = C.popularity(rows.select("content_id", "n"), "n").toPandas()
    assert np.allclose(place["place"], (n - np.searchsorted(values, place["n"].to_numpy(), "right")) / (n - 1))


def test_heterogeneity_p(spark):
    rows = spark.createDataFrame([("m", 1.0, 0.5), ("m", 2.0, 0.5), ("m", 4.0, 1.0), ("m", 1.0, 0.0), ("one", 1.0, 1.0)], "metric_id string, effect double, se double")
    got = {r["metric_id"]: r for r in I.cochran_q(rows, ["metric_id"]).collect()}
    w, e = np.array([4.0, 4.0, 1.0]), np.array([1.0, 2.0, 4.0])
    q = (w * (e - (w * e).sum() / w.sum()) ** 2).sum()
    assert got["m"]["q"] == pytest.approx(q) and got["m"]["p_value"] == pytest.approx(math.exp(-q / 2))
    assert got["one"]["p_value"] == 1.0


def test_moving_averages_and_ideals_equal_the_steps(spark):
    rng = np.random.default_rng(8)
    rows = [("k", i, float(rng.normal(0, 1))) for i in range(700)] + [("other", 3, 0.5)]
    df = spark.createDataFrame(rows, "metric string, at long, reward double")
    for rate in (0.01, 0.9):  # the second makes blocks of 130 rows
        got = {(r["metric"], r["at"]): (r["z"], r["ideal"]) for r in B.ema_path(df, ["metric"], "at", rate).collect()}
        mean, var, ideal = {}, {}, {}
        for m, i, x in rows:
            d = x - mean.get(m, 0.0)
            mean[m], var[m] = mean.get(m, 0.0) + rate * d, (1 - rate) * (var.get(m, 1.0) + rate * d * d)
            z = (x - mean[m]) / math.sqrt(max(var[m], 1e-8))
            ideal[m] = max(ideal.get(m, 0.0), z)
            assert got[m, i] == pytest.approx((z, ideal[m]), abs=1e-6)
