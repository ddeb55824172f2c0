"""Conflicts of a portfolio: every pair that shares something, made once."""

import random

from tidemetric.operators.analysis import portfolio_conflicts


def test_conflicts_are_all_pairs_that_share_and_are_not_shuffled(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, rng.sample(["a", "b", "c", "d"], rng.randint(0, 2)), rng.sample(["a", "x", "y"], rng.randint(0, 2))) for i in range(60)]
    rows += [(100, 0, ["a", "a", None], None), (100, 0, ["b"], ["x"]), (101, None, ["a"], ["x"])]
    got = portfolio_conflicts(spark.createDataFrame(rows, "experiment_id long, layer int, metrics array<string>, populations array<string>"))
    has = {}
    for i, layer, metrics, populations in rows:
        has.setdefault((layer, i), set()).update([("m", m) for m in metrics if m] + [("p", p) for p in populations or []])
    want = [(a[0], a[1], b[1], len(x & y)) for a, x in has.items() for b, y in has.items() if a[0] == b[0] is not None and a[1] < b[1] and x & y]
    assert sorted((r["layer"], r["first"], r["second"], r["shared"]) for r in got.collect()) == sorted(want) and len(want) > 100
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.lstrip().startswith("Aggregate")  # pairs are the last thing that is made
