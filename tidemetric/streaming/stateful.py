"""Stateful operators with event-time timers: breaches in order, playback sessions, online tests and their wealth.

State lives in Spark's RocksDB store under one value per key, and goes when a timer fires.
Rows that come late, but within the watermark, are put in order before they count.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemetric.functions import fdr
from tidemetric.operators.inference import checked_alpha

# Spark starts a worker of its own beside the driver for these, which has no --py-files: processors travel whole.
for _module in (sys.modules[__name__], fdr):
    cloudpickle.register_pickle_by_value(_module)

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ["experiment_id", "metric_id", "variant_id"]


def use_keyed_state(spark: SparkSession) -> None:
    """Timers and several states a key need this store; streams that run already keep their own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _wake(processor, at: int) -> None:
    """One timer a key: that of the earliest row that waits, in microseconds. What it finds due then goes at once."""
    when = at // 1000 + 1
    held = processor.timer.get()[0] if processor.timer.exists() else None
    if held is None or when < held:
        if held is not None:
            processor.handle.deleteTimer(held)
        processor.handle.registerTimer(when)
        processor.timer.update((when,))


def _due(processor, timer_values) -> list[tuple]:
    """Rows (key, value) that the watermark has passed, in order of their keys (time first); they wait no longer."""
    limit = timer_values.getCurrentWatermarkInMs() * 1000
    rows = sorted(processor.waiting.iterator())
    due = [r for r in rows if r[0][0] < limit]
    for name, _ in due:
        processor.waiting.removeKey(name)
    processor.timer.clear()
    if len(due) < len(rows):
        _wake(processor, rows[len(due)][0][0])
    return due


class BreachTracker(StatefulProcessor):
    """Counts breaches in a row; checks wait until the watermark has passed them, and then count in order of time."""

    def __init__(self, threshold: float, lower_is_better: bool, alert_at: int):
        self.threshold, self.lower_is_better, self.alert_at = threshold, lower_is_better, alert_at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "run int")
        self.timer = handle.getValueState("timer", "at long")
        self.waiting = handle.getMapState("waiting", "at long", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for at, value in zip(batch["check_time"], batch["current_value"], strict=True):
                self.waiting.updateValue((at.value // 1000,), (float(value),))
            _wake(self, batch["check_time"].min().value // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run = self.run.get()[0] if self.run.exists() else 0
        alerts = []
        for (at,), (value,) in _due(self, timerValues):
            breach = (value > self.threshold) == self.lower_is_better and value != self.threshold
            run = run + 1 if breach else 0
            if run == self.alert_at:
                alerts.append((*key, pd.Timestamp(at, unit="us"), value, run))
        self.run.update((run,))
        yield pd.DataFrame(alerts, columns=[*KEYS, "check_time", "current_value", "run"])

    def close(self) -> None:
        pass


def consecutive_breaches(checks: DataFrame, threshold: float, lower_is_better: bool, alert_at: int, lateness: str = "1 hour") -> DataFrame:
    """Alerts when a (experiment, metric, variant) breaches ``alert_at`` checks in a row; a good check resets.

    Checks count in order of check_time, however batches deliver them: each waits for the
    watermark, ``lateness`` behind the youngest check. One check a time and key: of several the
    last to come counts. Checks that are later than that are dropped. A value that equals the
    threshold, is null or no number is no breach.
    """
    use_keyed_state(checks.sparkSession)
    shape = "experiment_id string, metric_id string, variant_id string, check_time timestamp, current_value double, run int"
    rows = checks.select(*KEYS, "check_time", F.coalesce("current_value", F.lit(float("nan"))).alias("current_value")).filter("check_time is not null")
    rows = rows.withWatermark("check_time", lateness)
    return rows.groupBy(*KEYS).transformWithStateInPandas(BreachTracker(threshold, lower_is_better, alert_at), shape, "Append", "EventTime")


SESSION = ["user_id", "device_id", "content_id"]


class SessionTracker(StatefulProcessor):
    """One open session a key: beats in order of arrival; one that is older than the last is dropped and counted.

    Rows come and go as plain rows, times in microseconds: keys are many and hold few beats, so a frame for each costs more than its beats.
    """

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, beats long, dropped long, playing long, rebuffers long, rebuffering boolean, ratio long, bitrate long, height int, switches long, peak int")

    def _closed(self, key, s, by: str) -> Row:
        playing = s["playing"]
        length, start = (0, 0) if playing is None else ((s["last"] - playing) // 1000, (playing - s["first"]) // 1000)
        return _CLOSED(*key, s["first"], length, start, s["rebuffers"], s["ratio"] / s["beats"], s["bitrate"] / s["beats"], s["switches"], s["peak"], s["beats"], s["dropped"], by)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.open.get()
        s = dict(zip(_OPEN, held, strict=True)) if held else None
        before = s["last"] if s else None
        done = []
        for _, _, at, starting, stalled, bitrate, height in sorted((tuple(r[c] for c in _BEAT) for r in rows), key=lambda b: b[:2]):
            if s and at < s["last"]:
                s["dropped"] += 1
                continue
            if s and at - s["last"] > self.gap:
                done.append(self._closed(key, s, "gap"))
                s = None
            if s is None:
                s = dict.fromkeys(_OPEN, 0) | {"first": at, "playing": None, "rebuffering": False, "height": height}
            s["last"], s["beats"] = at, s["beats"] + 1
            s["playing"] = at if s["playing"] is None and not starting else s["playing"]
            s["rebuffers"] += int(stalled and not s["rebuffering"])
            s["switches"] += int(height != s["height"])
            s["rebuffering"], s["height"] = stalled, height
            s["ratio"], s["bitrate"], s["peak"] = s["ratio"] + int(stalled), s["bitrate"] + bitrate, max(s["peak"], height)
        self.open.update(tuple(s[c] for c in _OPEN))
        if before is None or s["last"] != before:
            if before is not None:
                self.handle.deleteTimer(self._expiry(before))
            self.handle.registerTimer(self._expiry(s["last"]))
        return iter(done)

    def _expiry(self, last: int) -> int:
        return (last + self.gap) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s = dict(zip(_OPEN, self.open.get(), strict=True))
        self.open.clear()
        return iter([self._closed(key, s, "expiry")])

    def close(self) -> None:
        pass


_OPEN = ["first", "last", "beats", "dropped", "playing", "rebuffers", "rebuffering", "ratio", "bitrate", "height", "switches", "peak"]
#: A beat as it travels; the first two order the beats of a batch.
_BEAT = ["arrived", "event_id", "at", "is_startup", "is_rebuffering", "current_bitrate_kbps", "current_resolution_height"]
_MEASURES = "session_start long, playback_duration_ms long, time_to_first_frame_ms long, rebuffer_count long, rebuffer_ratio double, avg_bitrate_kbps double, resolution_switches long, peak_resolution_height int, beats long, out_of_order long, closed_by string"
_CLOSED = Row(*SESSION, *(c.split()[0] for c in _MEASURES.split(", ")))


def tracked_sessions(beats: DataFrame, gap_seconds: int = 30, lateness: str = "1 minute") -> DataFrame:
    """Playback sessions as beats arrive: closed by a gap, or by a sweep once the watermark is ``gap_seconds`` past the last beat.

    A beat that is older than the last one of its open session is dropped; ``out_of_order``
    counts these. ``arrived_at`` orders the beats of one batch, ties by event_id. State is one
    row of sums an open session, whatever its length, and goes when it closes.
    """
    use_keyed_state(beats.sparkSession)
    kinds = dict(beats.dtypes)
    shape = ", ".join(f"{c} {kinds[c]}" for c in SESSION) + f", {_MEASURES}"
    rows = beats.filter("timestamp is not null").withWatermark("timestamp", lateness)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    last = lambda c: F.coalesce(c, F.lit((1 << 63) - 1))
    rows = rows.select(*SESSION, "timestamp", last(micros("arrived_at")).alias("arrived"), last(F.col("event_id")).alias("event_id"), micros("timestamp").alias("at"), *_BEAT[3:])
    out = rows.groupBy(*SESSION).transformWithState(SessionTracker(gap_seconds), shape, "Append", "EventTime")
    return out.withColumn("session_start", F.timestamp_micros("session_start"))


SUMS = ["n", "sy", "sx", "syy", "sxy", "sxx"]


def sequential_look(t: list[float], c: list[float], tau_sq: float, alpha: float) -> tuple[float, float, float] | None:
    """(effect, standard error, half width) of the regression-adjusted anytime-valid interval from both arms' sums."""
    if t[0] < 2 or c[0] < 2:
        return None
    n, m = t[0], c[0]
    spread = lambda s, i, j, k: s[k] - s[i] * s[j] / s[0]
    apart = n * m / (n + m)
    dy, dx = t[1] / n - c[1] / m, t[2] / n - c[2] / m
    xx = spread(t, 2, 2, 5) + spread(c, 2, 2, 5) + apart * dx * dx
    xy = spread(t, 2, 1, 4) + spread(c, 2, 1, 4) + apart * dx * dy
    theta = xy / xx if xx else 0.0
    own = lambda s: max(0.0, (spread(s, 1, 1, 3) - 2 * theta * spread(s, 2, 1, 4) + theta * theta * spread(s, 2, 2, 5)) / (s[0] - 1))
    se = math.sqrt(own(t) / n + own(c) / m)
    effect, n_eff = dy - theta * dx, 2.0 * apart
    if se == 0:
        return effect, 0.0, 0.0
    v = se * se * n_eff / tau_sq
    return effect, se, se * math.sqrt(2 * (v + n_eff) / n_eff * (math.log(1 / alpha) + 0.5 * math.log(1 + n_eff / v)))


class OnlineTest(StatefulProcessor):
    """Running sums per arm; an arm whose interval leaves 0 behind alerts, once."""

    def __init__(self, control: str, tau_sq: float, alpha: float):
        self.control, self.tau_sq, self.alpha = control, tau_sq, alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.arms = handle.getMapState("arms", "variant_id string", ", ".join(f"{c} double" for c in SUMS))
        self.crossed = handle.getMapState("crossed", "variant_id string", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arms = {name: list(sums) for (name,), sums in self.arms.iterator()}
        crossed = {name for (name,), _ in self.crossed.iterator()}
        alerts = []
        for at, look in pd.concat(list(rows)).groupby("look_time", sort=True):
            for row in look.itertuples():
                sums = arms.setdefault(row.variant_id, [0.0] * len(SUMS))
                arms[row.variant_id] = [s + float(getattr(row, c)) for s, c in zip(sums, SUMS, strict=True)]
            base = arms.get(self.control)
            for name in sorted(arms):
                seen = sequential_look(arms[name], base, self.tau_sq, self.alpha) if base and name != self.control and name not in crossed else None
                if seen and abs(seen[0]) > seen[2]:
                    crossed.add(name)
                    self.crossed.updateValue((name,), (at.value // 1000,))
                    alerts.append((*key, name, at, *seen, int(arms[name][0]), int(base[0])))
        for name, sums in arms.items():
            self.arms.updateValue((name,), tuple(sums))
        yield pd.DataFrame(alerts, columns=[*KEYS, "look_time", "effect", "se", "half_width", "n_t", "n_c"])

    def close(self) -> None:
        pass


def sequential_alerts(obs: DataFrame, time: str, control: str, tau_sq: float, alpha: float = 0.05, look: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """One alert for each (experiment, metric, arm), when its anytime-valid interval first excludes no effect.

    ``obs`` is a stream of (experiment_id, metric_id, variant_id, y, x) and a time. Spark sums
    observations per arm and ``look`` window, so a look is a row an arm however many came; a
    window that the watermark has closed is looked at, in order of time. Sums and arms that
    have crossed are kept per (experiment, metric). Null y are left out; a null x counts as 0.
    """
    checked_alpha(alpha)
    use_keyed_state(obs.sparkSession)
    x, y = F.coalesce("x", F.lit(0.0)).cast("double"), F.col("y").cast("double")
    rows = obs.filter("y is not null and variant_id is not null").withWatermark(time, lateness)
    summed = rows.groupBy("experiment_id", "metric_id", "variant_id", F.window(time, look).alias("w")).agg(
        F.count("*").cast("double").alias("n"), F.sum(y).alias("sy"), F.sum(x).alias("sx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx")
    )
    looks = summed.select("experiment_id", "metric_id", "variant_id", F.col("w.end").alias("look_time"), *SUMS)
    shape = "experiment_id string, metric_id string, variant_id string, look_time timestamp, effect double, se double, half_width double, n_t long, n_c long"
    return looks.groupBy("experiment_id", "metric_id").transformWithStateInPandas(OnlineTest(control, tau_sq, alpha), shape, "Append", "None")


#: Tests wait in pieces of this much event time, in microseconds; rows that are packed at a time, and decided at a time.
_SPAN, _PACK, _SLICE = 3_600_000_000, 1 << 20, 1 << 15


class FdrController(StatefulProcessor):
    """Wealth of a program; its tests wait for the watermark and are decided in order of time.

    What waits lies in packed pieces, one for an hour of event time and a million rows that came:
    no test is a call to the store of its own, and an hour of one program is what is held at once.
    """

    def __init__(self, alpha: float, decay: float, pack: int = _PACK):
        self.alpha, self.decay, self.pack, self.step = alpha, decay, pack, fdr.fdr_step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "tests int, rejections int, wealth double")
        self.timer = handle.getValueState("timer", "at long")
        self.last = handle.getValueState("last", "piece long")
        self.waiting = handle.getMapState("waiting", "hour long, piece long", "tests binary")

    def _put(self, held: list[pa.Table]) -> None:
        piece = (self.last.get()[0] if self.last.exists() else 0) + 1
        self.last.update((piece,))
        rows = pa.concat_tables(held).combine_chunks()
        hours = rows.column("at").to_numpy() // _SPAN
        order = np.argsort(hours, kind="stable")  # those that came first stay first
        rows, hours = rows.take(pa.array(order)), hours[order]
        starts = np.flatnonzero(np.diff(hours, prepend=hours[0] - 1))
        for start, end in zip(starts, np.append(starts[1:], len(hours)), strict=True):
            self._keep(int(hours[start]), piece, rows.slice(start, end - start))

    def _keep(self, hour: int, piece: int, rows: pa.Table) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        self.waiting.updateValue((hour, piece), (sink.getvalue().to_pybytes(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, n, first = [], 0, None
        for batch in rows:
            if not len(batch):
                continue
            at = batch["finished_at"].to_numpy("datetime64[us]").astype(np.int64)
            first = int(at.min()) if first is None else min(first, int(at.min()))
            held.append(pa.table({"at": at, "test_id": pa.array(batch["test_id"], pa.string()), "e_value": batch["e_value"].to_numpy(float)}))
            n += len(batch)
            if n >= self.pack:
                self._put(held)
                held, n = [], 0
        if held:
            self._put(held)
        if first is not None:
            _wake(self, first)
        return iter([])

    def _in_order(self, names: list[tuple[int, int]]) -> pa.Table:
        """The tests of an hour by time and id; of one that came again, what came last."""
        rows = pa.concat_tables([pa.ipc.open_stream(self.waiting.getValue(n)[0]).read_all() for n in names])
        rows = rows.append_column("came", pa.array(np.arange(len(rows))))
        rows = rows.sort_by([("at", "ascending"), ("test_id", "ascending"), ("came", "ascending")]).combine_chunks()
        again = pc.and_(pc.equal(rows["at"][1:], rows["at"][:-1]), pc.equal(rows["test_id"][1:], rows["test_id"][:-1])).combine_chunks()
        return rows.drop_columns("came").filter(pa.concat_arrays([pc.invert(again), pa.array([True])]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        tests, rejections, wealth = self.state.get() if self.state.exists() else (0, 0, self.alpha)
        hours: dict[int, list] = {}
        for hour, piece in sorted(tuple(k) for k in self.waiting.keys()):
            hours.setdefault(hour, []).append((hour, piece))
        self.timer.clear()
        for hour, names in hours.items():  # in order of time
            if hour * _SPAN >= limit:
                _wake(self, hour * _SPAN)
                break
            rows = self._in_order(names)
            due = int(np.searchsorted(rows["at"].to_numpy(), limit))
            for start in range(0, due, _SLICE):
                some = rows.slice(start, min(_SLICE, due - start))
                out = []
                for e in some["e_value"].to_pylist():
                    level, hit, wealth = self.step(wealth, tests, e, self.alpha, self.decay)
                    tests, rejections = tests + 1, rejections + int(hit)
                    out.append((level, hit, tests, rejections, wealth))
                decided = pd.DataFrame(out, columns=["level", "rejected", "tests", "rejections", "wealth"])
                own = {"program": key[0], "test_id": some["test_id"].to_pylist(), "finished_at": some["at"].to_numpy().astype("datetime64[us]"), "e_value": some["e_value"].to_numpy()}
                yield pd.concat([pd.DataFrame(own), decided], axis=1)
            for name in names:
                self.waiting.removeKey(name)
            if due < len(rows):
                self._keep(hour, names[-1][1], rows.slice(due))
                _wake(self, rows["at"][due].as_py())
                break
        self.state.update((tests, rejections, wealth))

    def close(self) -> None:
        pass


def online_fdr_stream(tests: DataFrame, alpha: float = 0.05, decay: float = 0.5, lateness: str = "1 hour") -> DataFrame:
    """Decisions of a program's tests (program, test_id, finished_at, e_value) as they finish, with the wealth after each.

    State is the wealth and what waits for the watermark, packed, never a program's history. Tests that
    finish at once are in order of their id; one that comes again before it is decided counts
    once. A null e-value is no evidence.
    """
    checked_alpha(alpha)
    use_keyed_state(tests.sparkSession)
    shape = "program string, test_id string, finished_at timestamp, e_value double, level double, rejected boolean, tests int, rejections int, wealth double"
    rows = tests.filter("finished_at is not null and test_id is not null").select("program", "test_id", "finished_at", F.coalesce("e_value", F.lit(0.0)).alias("e_value")).withWatermark("finished_at", lateness)
    return rows.groupBy("program").transformWithStateInPandas(FdrController(alpha, decay), shape, "Append", "EventTime")
