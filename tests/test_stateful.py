"""Streams with state: any order of batches gives the batch answer, and state stays bounded."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemetric.operators import inference as I
from tidemetric.operators.inference import arm_pairs, avlm, moments
from tidemetric.sources.store import shared_folder
from tidemetric.streaming import events as E
from tidemetric.streaming import stateful as S

START = dt.datetime(2024, 1, 1)
CHECKS = "experiment_id string, metric_id string, variant_id string, check_time timestamp, current_value double"
BEATS = "event_id long, user_id long, device_id long, content_id int, timestamp timestamp, arrived_at timestamp, is_startup boolean, is_rebuffering boolean, current_bitrate_kbps int, current_resolution_height int"
OBS = "experiment_id string, metric_id string, variant_id string, y double, x double, t timestamp"


def stream(spark, batches, shape):
    folder = shared_folder(spark, "stream-in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{folder}/{i:03}")
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def runs(checks, threshold, alert_at):
    out, count = [], {}
    for e, m, v, at, value in sorted(checks, key=lambda c: c[3]):
        count[(e, m, v)] = count.get((e, m, v), 0) + 1 if value is not None and value > threshold else 0
        if count[(e, m, v)] == alert_at:
            out.append((v, at))
    return sorted(out)


def test_late_checks_give_the_answer_of_checks_in_order(spark):
    rng = random.Random(4)
    checks = [("e", "m", v, START + dt.timedelta(hours=h), rng.choice([1.0, 9.0, 9.0, 9.0, None])) for h in range(40) for v in "ab"]
    late = sorted(checks, key=lambda c: (c[3] - START).total_seconds() / 3600 + rng.uniform(0, 4))
    batches = [late[i : i + 9] for i in range(0, len(late), 9)]
    last = ("e", "m", "a", START + dt.timedelta(days=9), 1.0)  # moves the watermark on
    got = E.run_once(S.consecutive_breaches(stream(spark, [*batches, [last]], CHECKS), 5.0, True, 3, "6 hours"), spark, shared_folder(spark, "late"))
    assert sorted((r["variant_id"], r["check_time"]) for r in got.collect()) == runs(checks, 5.0, 3)


def plain_sessions(beats, gap):
    out, open_ = [], {}
    for b in sorted(beats, key=lambda b: (b[5], b[0])):
        key, s = b[1:4], open_.get(b[1:4])
        if s and b[4] < s["last"]:
            s["dropped"] += 1
            continue
        if s and (b[4] - s["last"]).total_seconds() > gap:
            out.append((*key, s["n"], s["dropped"], "gap"))
            s = None
        s = s or {"n": 0, "dropped": 0}
        open_[key] = s
        s["n"], s["last"] = s["n"] + 1, b[4]
    return sorted(out + [(*k, s["n"], s["dropped"], "expiry") for k, s in open_.items()])


def test_sessions_count_late_beats_and_expire(spark):
    rng = random.Random(8)
    beats = []
    for i in range(120):
        at = START + dt.timedelta(seconds=rng.randint(0, 1500))
        beats.append((i, rng.randint(1, 3), 0, 5, at, at + dt.timedelta(seconds=rng.choice([0, 0, 20])), False, rng.random() < 0.3, 1000, 480))
    arrived = sorted(beats, key=lambda b: (b[5], b[0]))
    batches = [arrived[i : i + 30] for i in range(0, 120, 30)] + [[(999, 9, 0, 5, START + dt.timedelta(days=2), START + dt.timedelta(days=2), False, False, 1, 1)]]
    got = E.run_once(S.tracked_sessions(stream(spark, batches, BEATS), 30, "1 minute"), spark, shared_folder(spark, "tracked"))
    rows = sorted((r["user_id"], r["device_id"], r["content_id"], r["beats"], r["out_of_order"], r["closed_by"]) for r in got.collect())
    want = plain_sessions(beats, 30)
    assert [r[:5] for r in rows] == [w[:5] for w in want] and {r[5] for r in rows} == {"gap", "expiry"}
    assert sum(r[4] for r in rows) > 0


def test_tracked_measures_equal_those_of_session_windows(spark):
    at = [0, 10, 40, 71, 80, 200, 210]
    beats = [(i, 1, 0, 5, START + dt.timedelta(seconds=s), START + dt.timedelta(seconds=s), s == 0, s in (40, 210), 1000 + s, 480 if s < 80 else 720) for i, s in enumerate(at)]
    last = (99, 2, 0, 5, START + dt.timedelta(days=1), START, False, False, 1, 480)
    names = ["session_start", "playback_duration_ms", "time_to_first_frame_ms", "rebuffer_count", "rebuffer_ratio", "avg_bitrate_kbps", "resolution_switches", "peak_resolution_height", "beats"]
    got = E.run_once(S.tracked_sessions(stream(spark, [beats, [last]], BEATS)), spark, shared_folder(spark, "measures"))
    want = E.playback_sessions(spark.createDataFrame(beats, BEATS).drop("arrived_at"))
    rounded = lambda df: sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in df.select(names).collect())
    assert rounded(got) == rounded(want)


def test_an_arm_alerts_once_when_it_crosses_in_a_later_batch(spark):
    rng = random.Random(1)
    days = [[("e", "m", v, rng.gauss(1.5 if v == "b" and day > 2 else 0, 1), rng.gauss(0, 1), START + dt.timedelta(hours=6 * day + rng.random() * 6)) for v in "abc" for _ in range(80)] for day in range(7)]
    got = E.run_once(S.sequential_alerts(stream(spark, days, OBS), "t", "a", 0.5), spark, shared_folder(spark, "online")).collect()
    assert [(r["variant_id"]) for r in got] == ["b"] and got[0]["look_time"] > START + dt.timedelta(hours=18)
    upto = spark.createDataFrame([r for d in days for r in d], OBS).filter(F.col("t") < F.lit(got[0]["look_time"]))
    want = avlm(arm_pairs(moments(upto, [], covariate=True), [], "a"), 0.5).filter("variant_id = 'b'").first()
    assert (got[0]["effect"], got[0]["half_width"]) == pytest.approx((want["effect"], want["half_width"])) and want["significant"]
    earlier = avlm(arm_pairs(moments(upto.filter(F.col("t") < F.lit(got[0]["look_time"] - dt.timedelta(hours=1))), [], covariate=True), [], "a"), 0.5).filter("variant_id = 'b'").first()
    assert not earlier["significant"]


def test_looks_need_two_rows_and_survive_constant_data():
    assert S.sequential_look([1.0, 1, 0, 1, 0, 0], [5.0, 1, 0, 1, 0, 0], 0.5, 0.05) is None
    assert S.sequential_look([4.0, 8, 0, 16, 0, 0], [4.0, 4, 0, 4, 0, 0], 0.5, 0.05) == (1.0, 0.0, 0.0)


def test_counts_keep_ids_for_a_bounded_time(spark):
    shape = "event_id long, event_type string, ts timestamp, arrived timestamp"
    batches = []
    for i in range(20):
        at = START + dt.timedelta(hours=i)
        own = [(20 * i + k, "click", at, at + dt.timedelta(minutes=1)) for k in range(20)]
        again = [(r[0], "click", r[2], at + dt.timedelta(minutes=2)) for r in own[:5]] + ([(20 * i - 1, "click", at, at + dt.timedelta(minutes=3))] if i else [])
        batches.append([*own, *again, (None, "click", at, at)])
    source, folder = stream(spark, batches, shape), shared_folder(spark, "bounded")
    reason = E.failure_reason(["event_id"])
    total = E.count_stream(source, spark, folder, reason, "event_id", "ts", "arrived").first()
    assert (total["rows"], total["rejected"], total["accepted"], total["duplicates"]) == (20 * 26 + 19, 20, 400, 20 * 5 + 19)
    sizes = []
    valid = E.deduplicated(source.filter(reason.isNull()), ["event_type", "event_id"], "arrived")
    query = valid.writeStream.option("checkpointLocation", f"{folder}/again").trigger(availableNow=True).foreachBatch(lambda df, i: df.count()).start()
    query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(sizes) <= 5 * 20 and len(sizes) >= 20, pd.Series(sizes).describe()


def test_online_fdr_decides_late_tests_in_order(spark):
    rng = random.Random(11)
    tests = [(p, f"t{i}", START + dt.timedelta(hours=i), rng.choice([0.5, 0.5, 300.0, 4000.0, None])) for i in range(30) for p in ("a", "b")]
    late = sorted(tests, key=lambda t: (t[2] - START).total_seconds() / 3600 + rng.uniform(0, 4))
    shape = "program string, test_id string, finished_at timestamp, e_value double"
    batches = [late[i : i + 12] for i in range(0, len(late), 12)] + [[("c", "last", START + dt.timedelta(days=9), 1.0)]]
    got = E.run_once(S.online_fdr_stream(stream(spark, batches, shape), 0.05, 0.9, "6 hours"), spark, shared_folder(spark, "fdr")).collect()
    last = {p: max((r for r in got if r["program"] == p), key=lambda r: r["tests"]) for p in "ab"}
    want = {r["program"]: r for r in I.online_fdr(spark.createDataFrame(tests, shape), ["program"], "finished_at", 0.05, 0.9).collect()}
    assert len(got) == 60 and sum(r["rejected"] for r in got) > 3
    for p in "ab":
        assert (last[p]["tests"], last[p]["rejections"]) == (want[p]["tests"], want[p]["rejections"]) and last[p]["wealth"] == pytest.approx(want[p]["wealth"])


def test_tests_that_wait_are_packed_and_count_once(spark):
    shape = "program string, test_id string, finished_at timestamp, e_value double"
    rng = random.Random(5)
    tests = [("a", f"t{i * 7919 % 3000}", START + dt.timedelta(minutes=i // 20), rng.choice([0.5, 0.5, 4000.0])) for i in range(3000)]
    again = [(p, n, at, 300.0) for p, n, at, _ in tests[1000:1500:7]]  # before they are decided: what came last counts
    batches = [tests[:1500], again, tests[1500:], [("c", "last", START + dt.timedelta(days=9), 1.0)]]
    folder = shared_folder(spark, "packed")
    out = S.online_fdr_stream(stream(spark, batches, shape), 0.05, 0.99, "2 hours")
    query = out.writeStream.option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").format("parquet").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((tuple(r[c] for c in ("finished_at", "test_id", "e_value", "tests", "rejections")), r["wealth"]) for r in spark.read.schema(out.schema).parquet(f"{folder}/out").collect())
    left = {(at, n): e for _, n, at, e in tests[:1500] + again + tests[1500:]}
    wealth, hits, want = 0.05, 0, []
    for i, ((at, n), e) in enumerate(sorted(left.items())):
        _, hit, wealth = S.fdr.fdr_step(wealth, i, e, 0.05, 0.99)
        hits += hit
        want.append(((at, n, e, i + 1, hits), pytest.approx(wealth)))
    assert got == want and hits > 3
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) < 40


def test_a_session_of_a_key_takes_three_calls_to_the_store():
    calls, row = [], S.Row(*S._BEAT)
    held = type("Value", (), {"get": lambda self: calls.append("get"), "update": lambda self, v: calls.append(v)})()
    tracker = S.SessionTracker(30)
    tracker.open, tracker.handle = held, type("Handle", (), {"registerTimer": lambda self, at: calls.append(at), "deleteTimer": lambda self, at: calls.append(-at)})()
    second = 1_000_000
    beats = [row(2, 2, 90 * second, False, True, 10, 720), row(1, 1, 20 * second, True, False, 10, 480), row(3, 3, 80 * second, False, True, 10, 720)]
    done = list(tracker.handleInputRows((1, 0, 5), iter(beats), None))
    assert [(r.session_start, r.beats, r.closed_by) for r in done] == [(20 * second, 1, "gap")]
    state = dict(zip(S._OPEN, calls[1], strict=True))
    assert calls[0] == "get" and calls[2:] == [120_001] and (state["beats"], state["dropped"], state["rebuffers"]) == (1, 1, 1)
