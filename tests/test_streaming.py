import datetime as dt

from pyspark.sql import functions as F

from tidemetric.operators.sessions import playback_metrics
from tidemetric.sources.lake import synthetic_arms
from tidemetric.sources.store import check_fresh, shared_folder, write_partitions
from tidemetric.streaming import events as E

import pytest

START = dt.datetime(2024, 1, 1)
BEATS = "event_id long, user_id long, device_id long, content_id int, timestamp timestamp, is_startup boolean, is_rebuffering boolean, current_bitrate_kbps int, current_resolution_height int"


def beats():
    at = [0, 10, 40, 71, 80, 200, 210]
    return [(i, 1, 0, 5, START + dt.timedelta(seconds=s), s == 0, s in (40, 210), 1000 + s, 480 if s < 80 else 720) for i, s in enumerate(at)]


def test_stream_and_batch_sessions_agree(spark):
    folder = shared_folder(spark, "beats")
    rows = spark.createDataFrame([*beats(), (99, 1, 0, 5, START + dt.timedelta(days=1), False, False, 1, 480)], BEATS)
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    names = ["playback_duration_ms", "time_to_first_frame_ms", "rebuffer_count", "rebuffer_ratio", "avg_bitrate_kbps", "resolution_switches", "peak_resolution_height", "beats", "ebvs_detected"]
    streamed = E.run_once(E.playback_sessions(stream), spark, f"{folder}/out").select(names)
    batch = playback_metrics(spark.createDataFrame(beats(), BEATS)).select(names)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    assert batch.count() == 3


def test_reasons_name_the_first_broken_rule(spark):
    rows = spark.createDataFrame([("a", 1.0, START), ("", 1.0, START), ("b", float("nan"), START), ("c", 9.0, START), ("d", 1.0, START - dt.timedelta(days=3)), (None, None, None)], "id string, v double, t timestamp")
    reason = E.failure_reason(["id"], ["v"], {"v": (0, 5)}, "t", F.lit(START))
    assert [r[0] for r in rows.select(reason).collect()] == [None, "missing id", "v is not finite", "v is out of range", "t is too far off", "missing id"]
    good, bad = E.split_valid(rows, reason)
    assert good.count() == 1 and bad.count() == 5


def test_partition_overwrite_is_idempotent(spark):
    path = shared_folder(spark, "parts")
    one = spark.createDataFrame([("d1", 1), ("d2", 2)], "d string, x int")
    write_partitions(one, path, "d")
    write_partitions(one.filter("d = 'd1'").withColumn("x", F.lit(7)), path, "d")
    assert sorted((r["d"], r["x"]) for r in spark.read.parquet(path).collect()) == [("d1", 7), ("d2", 2)]


def test_freshness_gate(spark):
    catalog = spark.createDataFrame([(START,)], "updated_at timestamp")
    check_fresh(catalog, "2024-01-01 23:00:00")
    with pytest.raises(RuntimeError):
        check_fresh(catalog, "2024-01-02 01:00:00")
    with pytest.raises(RuntimeError):
        check_fresh(catalog.filter("false"), "2024-01-01 23:00:00")


@pytest.mark.parametrize(("kind", "c", "t"), [("normal", 8, 10), ("bernoulli", 0.5, 0.6), ("poisson", 3, 5)])
def test_synthetic_arms_have_their_means(spark, kind, c, t):
    got = {r["variant_id"]: r["m"] for r in synthetic_arms(spark.range(20_000).withColumnRenamed("id", "user_id"), kind).groupBy("variant_id").agg(F.avg("value").alias("m")).collect()}
    assert got["control"] == pytest.approx(c, rel=0.05) and got["treatment"] == pytest.approx(t, rel=0.05)
