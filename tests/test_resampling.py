"""Bootstrap and posterior draws against multinomial resampling, closed forms and exact integrals."""

from statistics import NormalDist

import numpy as np
import pytest

from tidemetric.operators import resampling as R

ROWS = "variant_id string, row_id long, y double"


def rows(spark, control, treatment):
    return spark.createDataFrame([(v, i, float(y)) for v, ys in (("control", control), ("t1", treatment)) for i, y in enumerate(ys)], ROWS)


def multinomial(control, treatment, replicates=20_000):
    rng = np.random.default_rng(0)
    c, t = (np.asarray(x)[rng.integers(0, len(x), (replicates, len(x)))].mean(1) for x in (control, treatment))
    return t - c


def plain_bca(control, treatment, alpha=0.05):
    """Textbook form: jackknife over every row of both arms."""
    effects, seen = np.sort(multinomial(control, treatment)), np.mean(treatment) - np.mean(control)
    left_out = [np.mean(np.delete(treatment, i)) - np.mean(control) for i in range(len(treatment))]
    left_in = [np.mean(treatment) - np.mean(np.delete(control, i)) for i in range(len(control))]
    u = np.concatenate([(len(treatment) - 1) * (np.mean(left_out) - left_out), (len(control) - 1) * (np.mean(left_in) - left_in)])
    u = np.concatenate([u[: len(treatment)] / len(treatment), u[len(treatment) :] / len(control)])
    a = (u**3).sum() / (6 * (u**2).sum() ** 1.5)
    z = NormalDist()
    z0 = z.inv_cdf((effects < seen).mean())
    return [np.quantile(effects, z.cdf(z0 + (z0 + z.inv_cdf(p)) / (1 - a * (z0 + z.inv_cdf(p))))) for p in (alpha / 2, 1 - alpha / 2)]


def test_percentile_interval_is_that_of_multinomial_resampling(spark):
    rng = np.random.default_rng(3)
    control, treatment = rng.normal(10, 2, 900), rng.normal(10.5, 3, 700)
    got = R.percentile_interval(R.bootstrap_replicates(rows(spark, control, treatment), 2000)).first()
    want = np.quantile(multinomial(control, treatment, 5000), [0.025, 0.975])
    assert (got["ci_lower"], got["ci_upper"]) == pytest.approx(tuple(want), abs=0.03)
    assert got["mean_effect"] == pytest.approx(treatment.mean() - control.mean(), abs=0.02)


def test_skewed_arms_move_the_corrected_interval(spark):
    rng = np.random.default_rng(5)
    control, treatment = rng.lognormal(0, 1.2, 500), rng.lognormal(0.2, 1.5, 400)
    data = rows(spark, control, treatment)
    draws = R.bootstrap_replicates(data, 4000)
    got = R.bca_interval(draws, data).first()
    low, high = plain_bca(control, treatment)
    width = high - low
    assert got["effect"] == pytest.approx(treatment.mean() - control.mean())
    assert (got["ci_lower"], got["ci_upper"]) == pytest.approx((low, high), abs=0.06 * width)
    plain = R.percentile_interval(draws).first()
    assert got["ci_upper"] > plain["ci_upper"] and got["ci_lower"] > plain["ci_lower"]  # the long tail is on the right


def test_replicates_repeat_and_leave_nulls_out(spark):
    data = spark.createDataFrame([("control", i, None if i % 7 == 0 else float(i % 5)) for i in range(300)] + [("t1", i, float(i % 5) + 1) for i in range(300)], ROWS).coalesce(1)
    one, two = ({(r["replicate"]): r["effect"] for r in R.bootstrap_replicates(data, 50).collect()} for _ in range(2))
    assert one == two and len(one) == 50 and 0.5 < np.mean(list(one.values())) < 1.5


@pytest.mark.parametrize(("s", "n", "sc", "nc"), [(60, 100, 20, 100), (50, 100, 50, 100), (5, 12, 2, 9)])
def test_posteriors_equal_the_exact_integral(spark, s, n, sc, nc):
    data = spark.createDataFrame([("m", "control", float(i < sc)) for i in range(nc)] + [("m", "t1", float(i < s)) for i in range(n)] + [("m", "t1", None)], "metric_id string, variant_id string, y double")
    got = R.bayes_beta_binomial(data, ["metric_id"]).first()
    x = (np.arange(20_000) + 0.5) / 20_000
    density = lambda a, b: (lambda p: p / p.sum())(np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x)))
    t, c = density(1 + s, 1 + n - s), density(1 + sc, 1 + nc - sc)
    assert got["p_superior"] == pytest.approx(float((t * (np.cumsum(c) - c / 2)).sum()), abs=0.006)
    assert got["mean_difference"] == pytest.approx((1 + s) / (2 + n) - (1 + sc) / (2 + nc), abs=0.003)
    assert got["ci_lower"] < got["mean_difference"] < got["ci_upper"]
