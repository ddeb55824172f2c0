import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemetric.operators import catalog as C
from tidemetric.operators import metrics as M
from tidemetric.operators.custom import checked_select
from tidemetric.operators.exposure import exposed_users
from tidemetric.plans.runner import Step, run_metrics

DAY = dt.datetime(2024, 1, 8)


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (1, 1, "view", 2.0, 10, DAY), (2, 1, "view", 4.0, 11, DAY + dt.timedelta(hours=1)), (3, 1, "buy", 5.0, 10, DAY + dt.timedelta(hours=30)),
        (4, 2, "view", None, 10, DAY), (5, 2, "buy", 1.0, None, DAY), (6, 3, "click", 1.0, 12, DAY), (7, 9, "view", 7.0, 10, DAY),
    ]
    return spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, content_id int, event_timestamp timestamp_ntz").withColumn("event_date", F.to_date("event_timestamp"))


@pytest.fixture(scope="module")
def users(spark):
    rows = [("e", u, v, p, DAY + dt.timedelta(hours=h)) for u, v, p, h in [(1, "control", 0.5, 0), (1, "control", 0.4, 5), (2, "t1", 0.5, 0), (3, "t1", 0.5, 1), (1, "t1", 0.5, 2)]]
    return exposed_users(spark.createDataFrame(rows, "experiment_id string, user_id long, variant_id string, assignment_probability double, event_timestamp timestamp_ntz"))


def values(df):
    return {(r["user_id"], r["variant_id"]): r["metric_value"] for r in df.collect()}


def test_exposed_users_keep_both_arms_and_the_least_probability(users):
    got = {(r["user_id"], r["variant_id"]): r["assignment_probability"] for r in users.collect()}
    assert got == {(1, "control"): 0.4, (1, "t1"): 0.5, (2, "t1"): 0.5, (3, "t1"): 0.5}


def test_each_type_has_its_rule_for_users_without_events(events, users):
    assert values(M.mean(events, users, "view")) == {(1, "control"): 3.0, (1, "t1"): 3.0, (2, "t1"): None}
    assert values(M.count(events, users, "view")) == {(1, "control"): 2.0, (1, "t1"): 2.0, (2, "t1"): 0.0, (3, "t1"): 0.0}
    assert values(M.proportion(events, users, "view")) == {(1, "control"): 1.0, (1, "t1"): 1.0, (2, "t1"): 1.0, (3, "t1"): 0.0}
    assert values(M.filtered_mean(events, users, "view", "value", F.col("value") > 3))[(3, "t1")] is None


def test_ratio_is_the_ratio_of_two_sums(events, users):
    assert values(M.ratio(events, users, "view", "buy")) == {(1, "control"): 6.0 / 5.0, (1, "t1"): 6.0 / 5.0, (2, "t1"): 0.0, (3, "t1"): 0.0}


def test_window_counts_from_the_first_exposure(events, users):
    assert values(M.windowed_count(events, users, "buy", 24))[(1, "control")] == 0.0
    assert values(M.windowed_count(events, users, "buy", 31))[(1, "control")] == 1.0
    with pytest.raises(ValueError):
        M.windowed_count(events, users, "buy", 0)


def test_expression_arguments_are_checked(events, users):
    for bad in (dict(fn="count", field="value"), dict(fn="mean"), dict(fn="median", field="value"), dict(fn="percentile", field="value"), dict(fn="mean", field="value", p=0.5)):
        with pytest.raises(ValueError):
            M.expr_aggregate(events, users, event_type="view", **bad)
    with pytest.raises(ValueError):
        M.composite(M.compute_metrics(events, users, {"a": ("count", "view")}), "ADD", ["a"])


def test_shared_scan_equals_single_metrics(events, users):
    both = M.compute_metrics(events, users, {"m": ("mean", "view"), "c": ("count", "view"), "p": ("proportion", "buy")})
    for name, single in (("m", M.mean(events, users, "view")), ("c", M.count(events, users, "view")), ("p", M.proportion(events, users, "buy"))):
        assert values(both.filter(F.col("metric_id") == name)) == {k: v for k, v in values(single).items() if v is not None}


def test_gini_and_entropy_bounds(spark):
    even = spark.createDataFrame([("a", i, 5) for i in range(4)], "variant_id string, content_id int, n long")
    one = spark.createDataFrame([("a", i, 20 if i == 3 else 0) for i in range(4)], "variant_id string, content_id int, n long")
    assert C.gini(even, "content_id").first()["metric_value"] == pytest.approx(0.0)
    assert C.gini(one, "content_id").first()["metric_value"] == pytest.approx(0.75)
    assert C.entropy(even, ["variant_id"]).first()["metric_value"] == pytest.approx(1.3862943611)


def test_runner_skips_cycles_and_dependents_of_failures(events, users):
    def broken(_):
        raise RuntimeError

    steps = [Step("a", (), lambda _: M.count(events, users, "view")), Step("b", (), broken), Step("c", ("a", "b"), lambda d: d), Step("x", ("y",), lambda d: d), Step("y", ("x",), lambda d: d)]
    run = run_metrics(steps)
    assert run.status == {"a": "ok", "b": "failed: RuntimeError", "c": "skipped: b", "x": "skipped: cycle", "y": "skipped: cycle"}
    assert run.values.count() == 4


@pytest.mark.parametrize("sql", ["DROP TABLE x", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) DELETE FROM t", "INSERT INTO t SELECT 1", "select * from t where 1=1 -- x\n; drop table t"])
def test_custom_sql_refuses_what_changes_anything(sql):
    with pytest.raises(ValueError):
        checked_select(sql)


def test_empty_tables_give_no_rows(events, users):
    none = events.filter("false")
    assert M.mean(none, users, "view").count() == 0
    assert M.count(none, users, "view").count() == 4
    assert C.catalog_gini(C.impressions(none, users), events.select("content_id")).count() == 0
