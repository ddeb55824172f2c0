import pytest
from pyspark.sql import functions as F

from tidemetric.functions.predicates import all_of, filter_text, targeting
from tidemetric.operators import analysis as A
from tidemetric.operators import assignment as S
from tidemetric.operators import bandit as B
from tidemetric.operators import offpolicy as O
from tidemetric.plans import catalogue
from tidemetric.sources import views as V

EXPERIMENTS = [
    S.Experiment("h", "hs", 0, 999, [("holdout", 1.0)], "x", is_holdout=True),
    S.Experiment("a", "as", 0, 9999, [("control", 0.5), ("t1", 0.25), ("t2", 0.25)], "x"),
    S.Experiment("b", "bs", 0, 9999, [("control", 0.5), ("t1", 0.5)], "y"),
]


@pytest.fixture(scope="module")
def users(spark):
    return spark.range(4000).withColumnRenamed("id", "user_id")


def test_shares_and_reruns(users):
    one = {r["user_id"]: r["variant_id"] for r in S.assign_variants(users, EXPERIMENTS[1]).collect()}
    again = {r["user_id"]: r["variant_id"] for r in S.assign_variants(users.repartition(3), EXPERIMENTS[1]).collect()}
    assert one == again
    for name, share in (("control", 0.5), ("t1", 0.25), ("t2", 0.25)):
        assert sum(v == name for v in one.values()) / 4000 == pytest.approx(share, abs=0.03)


def test_holdouts_claim_their_layer(users):
    rows = S.assign_all(users, EXPERIMENTS).collect()
    held = {r["user_id"] for r in rows if r["experiment_id"] == "h"}
    assert held and not held & {r["user_id"] for r in rows if r["experiment_id"] == "a"}
    assert len({r["user_id"] for r in rows if r["experiment_id"] == "b"}) == 4000


def test_parity_audit_counts_what_differs(users):
    assigned = S.assign_all(users, EXPERIMENTS[1:2])
    logged = assigned.withColumn("variant_id", F.when(F.col("user_id") < 7, "other").otherwise(F.col("variant_id")))
    assert tuple(S.parity_audit(assigned, logged).first()) == ("a", 4000, 7)


def test_targeting_of_missing_and_odd_values(spark):
    rows = spark.createDataFrame([({"age": "30", "plan": "pro"},), ({"age": "old"},), ({},), (None,)], "a map<string,string>")
    rule = targeting(F.col("a"), [[("age", "GTE", ["18"]), ("plan", "EQUALS", ["free"])]])
    assert [r[0] for r in rows.select(rule).collect()] == [True, False, False, False]
    assert [r[0] for r in rows.select(targeting(F.col("a"), [])).collect()] == [True] * 4
    assert [r[0] for r in rows.select(targeting(F.col("a"), [[]])).collect()] == [False] * 4
    assert [r[0] for r in rows.select(targeting(F.col("a"), [[("plan", "NOT_IN", ["x"])]])).collect()] == [True, False, False, False]


@pytest.mark.parametrize("text", ["1=1; drop table t", "x in (select 1)", "sleep(5) = 1", "a -- b", "a union all"])
def test_filter_text_refuses_more_than_a_predicate(text):
    with pytest.raises(ValueError):
        filter_text(text)


def test_rule_lists_check_fields_and_operators(spark):
    assert spark.range(10).filter(all_of([("id", ">", 3), ("id", "IN", [1, 5, 7])])).count() == 2
    for bad in ([("id; x", "=", 1)], [("id", "LIKE", "x")]):
        with pytest.raises(ValueError):
            all_of(bad)


@pytest.mark.parametrize("kind", ["team_draft", "multileave", "optimized"])
def test_interleaved_lists_are_fair_and_without_repeats(spark, kind):
    rows = [(u, a, r, (r * (i + 1) + u) % 30) for u in range(40) for i, a in enumerate("abc") for r in range(8)]
    rankings = spark.createDataFrame(rows, "user_id long, algorithm string, rank int, item int").dropDuplicates(["user_id", "algorithm", "item"])
    lists = {(r["user_id"], r["algorithm"], r["item"]) for r in rankings.collect()}
    out = B.interleave(rankings, kind, 6).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, B.interleave(rankings.repartition(5), kind, 6).collect()))
    for u in range(40):
        own = [r for r in out if r["user_id"] == u]
        assert len({r["item"] for r in own}) == len(own) == 6
        assert all((u, r["algorithm"], r["item"]) in lists for r in own)
        if kind != "optimized":
            counts = [sum(r["algorithm"] == a for r in own) for a in "abc"]
            assert max(counts) - min(counts) <= 1


def test_selection_probabilities_sum_to_one(spark):
    p = spark.createDataFrame([("e", 0, 50.0, 2.0), ("e", 1, 2.0, 50.0), ("e", 2, 1.0, 400.0)], "experiment_id string, arm_id int, alpha double, beta double")
    got = {r["arm_id"]: r["probability"] for r in B.selection_probabilities(p).collect()}
    assert sum(got.values()) == pytest.approx(1.0) and got[0] > 0.99 and min(got.values()) > 0


def test_composed_rewards(spark):
    row = spark.createDataFrame([(1.0, -0.5)], "a double, b double")
    z = {"a": F.col("a"), "b": F.col("b")}
    got = row.select(B.composed(z, "weighted", {"a": 0.5, "b": 2.0}), B.composed(z, "epsilon_constraint", {"a": 1.0}, floors={"b": 0.0}), B.composed(z, "tchebycheff", {"a": 1.0, "b": 1.0}, {"a": F.lit(1.0), "b": F.lit(1.0)})).first()
    assert tuple(got) == pytest.approx((-0.5, -4.0, -1.5))


def test_bradley_terry_orders_and_sums(spark):
    wins = spark.createDataFrame([("a", "b", 30), ("b", "a", 10), ("b", "c", 25), ("c", "b", 5), ("a", "c", 28)], "winner string, loser string, wins long")
    got = {r["algorithm"]: r["strength"] for r in A.bradley_terry(wins).collect()}
    assert sum(got.values()) == pytest.approx(1.0) and got["a"] > got["b"] > got["c"]


def test_off_policy_value_of_the_logging_policy_is_its_mean_return(spark):
    rows = [(u, t, [float(u % 3), float(t)], (u + t) % 2, float((u * t) % 4), 0.5) for u in range(60) for t in (1, 2, 3)]
    steps = spark.createDataFrame(rows, "user_id int, trajectory_step int, state_features array<double>, action_id int, reward double, logging_probability double")
    got = O.dr_off_policy(steps, 3, 2, 1.0, 100.0, F.lit(0.5)).first()
    mean = sum(r[4] for r in rows) / 60
    assert got["ips_value"] == pytest.approx(mean) and got["clip_share"] == 0 and got["ess"] == pytest.approx(60)
    assert got["dr_value"] == pytest.approx(mean, abs=0.3)


def test_guardrail_runs_and_promotion(spark):
    checks = spark.createDataFrame([("e", "m", "t", i, v) for i, v in enumerate([6, 7, 1, 8, 9, 9, 2])], "experiment_id string, metric_id string, variant_id string, check_time int, current_value int")
    got = A.guardrail_breaches(checks, 5, True, 3).collect()
    assert [(r["since"], r["until"], r["run"]) for r in got] == [(3, 5, 3)]
    days = spark.createDataFrame([(s, f"2024-01-{d:02d}", ok) for s, ds, bad in (("few", range(1, 5), 0), ("good", range(1, 9), 0), ("gap", [*range(1, 7), 9, 10], 0), ("bad", range(1, 9), 3)) for d in ds for ok in [d != bad]], "shadow_id string, d string, passes boolean")
    status = {r["shadow_id"]: r["status"] for r in A.shadow_promotion(days.withColumn("metric_date", F.to_date("d"))).collect()}
    assert status == {"few": "pending", "good": "approved", "gap": "rejected", "bad": "rejected"}


def folded_shares(picks, rate, arms):
    shares = dict.fromkeys(arms, 1 / len(arms))
    for pick in picks:
        shares = {a: (1 - rate) * s + rate * (pick == a) for a, s in shares.items()}
    return shares


def test_allocation_shares_by_ranges_equal_the_fold(spark):
    rows = [(f"e{k}", i // 2, (i * i + k) % 3) for k, n in enumerate((500, 7, 1)) for i in range(n)]
    out = B.allocation_shares(spark.createDataFrame(rows, "experiment_id string, at int, arm_id int").repartition(5), "at", 0.01, [0, 1, 2, 3], 0.05, 0.6)
    got = {(r["experiment_id"], r["arm_id"]): r["share"] for r in out.collect()}
    want = {(e, a): s for e in ("e0", "e1", "e2") for a, s in folded_shares([arm for x, _, arm in sorted(rows) if x == e], 0.01, [0, 1, 2, 3]).items()}
    assert got == pytest.approx(want)
    assert "collect_list" not in out._jdf.queryExecution().toString()  # no key's rows in one array


def test_allocation_query_folds_the_whole_table(spark, small):
    picks = [r["arm_id"] for r in V.reward_events(spark, small).orderBy("event_id").collect()]
    got = {r["arm_id"]: r["share"] for r in catalogue.queries()["b11_allocation_ema"](spark, small).collect()}
    assert got == pytest.approx(folded_shares(picks, 0.05, [0, 1, 2, 3]), abs=1e-6)


def test_reward_averages_by_ranges_equal_the_fold(spark):
    rows = [(f"e{k}", i, float((i * i + k) % 7)) for k, n in enumerate((3000, 7, 1)) for i in range(n)]
    out = B.ema_normalised(spark.createDataFrame(rows, "experiment_id string, at int, reward double").repartition(5), ["experiment_id"], "at", 0.02)
    got = {r["experiment_id"]: (r["mean"], r["variance"], r["z"]) for r in out.collect()}
    for name in ("e0", "e1", "e2"):
        mean, variance = 0.0, 1.0
        for _, _, reward in sorted(r for r in rows if r[0] == name):
            delta = reward - mean
            mean, variance = mean + 0.02 * delta, 0.98 * (variance + 0.02 * delta * delta)
        assert got[name] == pytest.approx((mean, variance, (reward - mean) / variance**0.5))
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_wins_are_tested_exactly_or_by_chi_square(spark):
    wins = spark.createDataFrame([("a", 9), ("b", 1), ("c", 5)], "algorithm string, wins long")
    assert A.win_test(wins, ["a", "b"]).first()["p_value"] == pytest.approx(0.021484375)
    assert A.win_test(wins, ["a", "b", "c"]).first()["p_value"] == pytest.approx(0.040762, abs=1e-6)  # exp(-6.4 / 2)
    assert A.win_test(wins.filter("false"), ["a", "b"]).first()["p_value"] == 1.0
    assert A.win_test(wins.filter("false"), ["a", "b", "c"]).first()["p_value"] == 1.0


def test_interference_and_feedback_decisions(spark):
    same = [(v, c, 100.0, 50) for v in ("control", "t") for c in range(20)]
    columns = "variant_id string, content_id int, watch_time_seconds double, view_count long"
    for rows, want in ((same, False), ([*same[:39], ("t", 19, 100.0, 400)], True), ([*same[:39], ("t", 19, 5000.0, 50)], True)):
        df = spark.createDataFrame(rows, columns)
        spill = A.spillover_tests(A.title_spillover(df, "t"))
        assert A.interference_decision(A.consumption_divergence(df, "t"), spill).first()["interference_detected"] is want
    shifts = spark.createDataFrame([(0.1, 0.0, 0.31), (0.3, 0.0, 0.92), (0.2, 0.0, 0.60), (0.4, 0.0, 1.21)], "treatment_contamination_fraction double, pre_effect double, post_effect double")
    found = A.feedback_decision(A.feedback_loop(shifts)).first()
    assert found["detected"] and found["p_value"] == pytest.approx(0.0301, abs=2e-3) and found["correlation"] > 0.99
    flat = shifts.withColumn("post_effect", F.col("pre_effect"))
    calm = A.feedback_decision(A.feedback_loop(flat)).first()
    assert not calm["detected"] and calm["p_value"] == 1.0


def test_users_are_drafted_across_batches(spark):
    rows = [(u, a, r, (r * (2 if a == "x" else 3) + u) % 11) for u in range(300) for a in ("x", "y") for r in range(1, 6)]
    rankings = spark.createDataFrame(rows, "user_id long, algorithm string, rank int, item int")
    whole = sorted(map(tuple, B.interleave(rankings).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, B.interleave(rankings).collect())) == whole and len({r[0] for r in whole}) == 300
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
