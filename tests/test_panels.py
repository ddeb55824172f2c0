"""Novelty, switchback and synthetic control against known answers and plain computations."""

import numpy as np
import pytest

from tidemetric.functions import distributions as D
from tidemetric.operators import panels as P

PANEL = "experiment_id string, unit_id string, period int, value double, is_treated_unit boolean, is_post boolean"
# Published panels of two donors, with the range their effect lies in.
D1, D2 = [1.0, 2, 3, 4, 5, 6, 7, 8], [2.0, 4, 6, 8, 10, 12, 14, 16]
PERFECT, SLIGHT = [1.4, 2.8, 4.2, 5.6, 7.0, 10.4, 11.8, 13.2], [1.5, 2.9, 4.3, 5.8, 7.2, 10.4, 11.8, 13.2]


def panel(spark, treated, donors, pre):
    rows = [("e", name, t, float(v), name == "T", t >= pre) for name, series in [("T", treated), *donors] for t, v in enumerate(series)]
    return spark.createDataFrame(rows, PANEL)


def five_donors(seed=4):
    rng = np.random.default_rng(seed)
    base = np.cumsum(rng.normal(0, 1, 14)) + 20
    donors = [(f"D{k}", base + rng.normal(0, 1, 14) + k) for k in range(5)]
    treated = 0.5 * donors[1][1] + 0.5 * donors[3][1] + rng.normal(0, 0.3, 14) + np.where(np.arange(14) >= 10, 3.0, 0.0)
    return treated, donors


def parts(treated, donors, pre=10):
    x = np.array([s for _, s in donors]).T
    return x[:pre], x[pre:], np.asarray(treated[:pre], float), np.asarray(treated[pre:], float)


def test_published_panels(spark):
    classic = P.synthetic_control(panel(spark, PERFECT, [("D1", D1), ("D2", D2)], 5)).first()
    assert classic["att"] == pytest.approx(2.0, abs=1e-3)
    augmented = P.synthetic_control(panel(spark, SLIGHT, [("D1", D1), ("D2", D2)], 5), "augmented").first()
    assert 1.5 <= augmented["att"] <= 2.5 and augmented["ci_lower"] < augmented["att"] < augmented["ci_upper"]
    ramp = [[float(t + k) for t in range(10)] for k in (1, 2, 3)]
    three = P.synthetic_control(panel(spark, [1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5, 10.0, 11.0, 12.0], list(zip("abc", ramp, strict=True)), 7), "augmented").first()
    assert 1.0 <= three["att"] <= 2.0


def test_classic_interval_is_the_spread_of_its_placebos(spark):
    treated, donors = five_donors()
    got = P.synthetic_control(panel(spark, treated, donors, 10)).first()
    placebos = []
    for k in range(5):
        x = np.array([s for j, (_, s) in enumerate(donors) if j != k]).T
        w = P.simplex_fit(x[:10], donors[k][1][:10])
        placebos.append(float((donors[k][1][10:] - x[10:] @ w).mean()))
    se = np.std(placebos, ddof=1)
    assert got["se"] == pytest.approx(se) and got["ci_upper"] - got["ci_lower"] == pytest.approx(2 * 1.959964 * se, rel=1e-6)
    assert got["donors"] == 5 and got["p_value"] == pytest.approx((1 + sum(abs(p) >= abs(got["att"]) for p in placebos)) / 6)


def test_augmented_interval_comes_from_residuals_before_the_treatment(spark):
    treated, donors = five_donors(7)
    pre, post, y, after = parts(treated, donors)
    got = P.synthetic_control(panel(spark, treated, donors, 10), "augmented").first()
    w = P.simplex_fit(pre, y)
    rest = y - pre @ w
    beta = np.linalg.solve(pre.T @ pre + 0.1 * np.trace(pre.T @ pre) / 10 / 5 * np.eye(5), pre.T @ rest)
    assert got["att"] == pytest.approx((after - post @ w).mean() + (post @ beta).mean()) and got["se"] == pytest.approx(np.std(rest, ddof=1))


def test_difference_form_by_hand_on_five_donors(spark):
    treated, donors = five_donors(9)
    got = P.synthetic_control(panel(spark, treated, donors, 10), "did").first()

    def att(keep, drop=None):
        pre, post, y, after = parts(treated, [donors[k] for k in keep])
        times = P.simplex_fit(pre.T, post.mean(0))
        units = P.simplex_fit((times @ pre)[None, :], np.array([times @ y]))
        gaps = (after - times @ y) - (post - times @ pre) @ units
        return gaps.mean(), gaps

    effect, gaps = att(range(5))
    without = np.array([np.delete(gaps, t).mean() for t in range(4)])
    assert got["att"] == pytest.approx(effect) and effect == pytest.approx(3.0, abs=1.5)
    assert got["se"] == pytest.approx(np.sqrt(3 / 4 * ((without - without.mean()) ** 2).sum()))
    dropped = np.array([att([k for k in range(5) if k != out])[0] for out in range(5)])
    assert got["jackknife_se"] == pytest.approx(np.sqrt(4 / 5 * ((dropped - dropped.mean()) ** 2).sum()))


def test_one_period_after_and_one_donor(spark):
    treated, donors = five_donors()
    lone = P.synthetic_control(panel(spark, treated[:11], [(n, s[:11]) for n, s in donors], 10), "did").first()
    assert lone["se"] == pytest.approx(0.5 * max(abs(lone["att"]), 1e-3))
    single = P.synthetic_control(panel(spark, treated, donors[:1], 10)).first()
    assert single["p_value"] == 1.0 and single["se"] == pytest.approx(np.std(treated[:10])) and single["jackknife_se"] is None
    assert P.synthetic_control(panel(spark, treated, [], 10)).count() == 0


@pytest.mark.parametrize(("s", "a", "d", "found"), [(5.0, 3.0, 4.0, True), (5.0, -2.0, 5.0, True), (2.0, 0.0, 1.0, False)])
def test_novelty_recovers_its_decay(spark, s, a, d, found):
    rng = np.random.default_rng(2)
    rows = [("m", t, s + a * np.exp(-t / d) + rng.normal(0, 0.02), 1000) for t in range(28)] + [("few", t, 1.0, 10) for t in range(6)]
    got = P.novelty(spark.createDataFrame([(m, t, float(e), n) for m, t, e, n in rows], "metric_id string, day int, effect double, sample_size long"), ["metric_id"], grid=200).collect()
    assert [r["metric_id"] for r in got] == ["m"]
    fit = got[0]
    assert fit["steady_effect"] == pytest.approx(s, abs=0.1) and fit["detected"] == found and fit["stabilised"]
    if found:
        assert fit["novelty_amplitude"] == pytest.approx(a, rel=0.05) and fit["decay_days"] == pytest.approx(d, rel=0.1)


def test_carry_over_is_the_residuals_autocorrelation(spark):
    rng = np.random.default_rng(6)
    arm = np.arange(30) % 2
    value = 10 + 2.0 * arm + np.cumsum(rng.normal(0, 0.5, 30))
    series = spark.createDataFrame([("e", int(b), int(a), float(v), 5) for b, (a, v) in enumerate(zip(arm, value, strict=True))], "experiment_id string, block long, arm int, value double, n long")
    got = P.switchback_effect(series, ["experiment_id"]).first()
    slope, start = np.polyfit(arm, value, 1)
    e = value - start - slope * arm
    r = (e[1:] * e[:-1]).sum() / (e * e).sum()
    t = r * np.sqrt(28 / (1 - r * r))
    assert (got["effect"], got["lag1_autocorrelation"], got["carry_over_t"]) == pytest.approx((slope, r, t))
    assert got["carry_over_p"] == pytest.approx(D.t_two_sided([t], [28])[0])
    s = (arm - arm.mean()) * e
    h = got["bandwidth"]
    omega = sum((1 if i == j else 1 - abs(i - j) / (h + 1)) * s[i] * s[j] for i in range(30) for j in range(30) if abs(i - j) <= h)
    assert got["se"] == pytest.approx(np.sqrt(max(omega, 0)) / ((arm - arm.mean()) ** 2).sum())
