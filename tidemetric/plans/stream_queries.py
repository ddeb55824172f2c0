"""Streaming queries: each drains the event table as a stream and returns what its sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemetric.operators import inference as I
from tidemetric.plans.registry import query, rounded
from tidemetric.sources import views as V
from tidemetric.sources.store import shared_folder
from tidemetric.streaming import events as E
from tidemetric.streaming import stateful as S

_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark, sf):
    raw = E.read_events(spark, sf, _SCHEMA, pathGlobFilter="events.parquet")
    return raw.select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("content_id"), F.col("ts").cast("timestamp").alias("event_timestamp"))


_REASON = dict(required=["event_id", "event_type"], finite=["value"], ranges={"value": (0, 100), "content_id": (0, 97)})


@query("SELECT coalesce(CASE WHEN NOT value BETWEEN 0 AND 100 THEN 'value is out of range' WHEN NOT content_id BETWEEN 0 AND 97 THEN 'content_id is out of range' END, 'valid') AS outcome, count(*) AS n FROM metric_events GROUP BY 1")
def t1_validate_split(spark, sf):
    folder = shared_folder(spark, "t1")
    E.run_once(_stream(spark, sf), spark, folder, write=E.validating_write(f"{folder}/valid", f"{folder}/rejects", E.failure_reason(**_REASON)))
    good = spark.read.parquet(f"{folder}/valid").select(F.lit("valid").alias("outcome"))
    bad = spark.read.parquet(f"{folder}/rejects").select(F.col("reject_reason").alias("outcome"))
    return good.unionByName(bad).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM metric_events GROUP BY 1")
def t2_deduplicate(spark, sf):
    """Every event is delivered twice; one of them passes."""
    twice = _stream(spark, sf).withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    out = E.run_once(E.deduplicated(twice, ["event_id"], "event_timestamp", "72 hours"), spark, shared_folder(spark, "t2"))
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id % 3 AS model_id, day AS window_start FROM (SELECT DISTINCT user_id % 3 AS user_id, event_date::varchar AS day FROM metric_events)")
def t3_retraining_dedup(spark, sf):
    stream = _stream(spark, sf).select((F.col("user_id") % 3).alias("model_id"), F.to_date("event_timestamp").cast("string").alias("window_start"), "event_timestamp")
    out = E.run_once(E.deduplicated(stream, ["model_id", "window_start"], "event_timestamp", "960 hours"), spark, shared_folder(spark, "t3"))
    return out.select("model_id", "window_start")


def _beats(rows, *more):
    k = F.col("content_id")
    return rows.select(
        *more, "event_id", "user_id", (F.col("user_id") % 2).alias("device_id"), "content_id", F.col("event_timestamp").alias("timestamp"), (F.col("event_type") == "signup").alias("is_startup"),
        (F.col("event_type") == "error").alias("is_rebuffering"), (1000 + 10 * k).alias("current_bitrate_kbps"), F.element_at(F.array(F.lit(480), F.lit(720), F.lit(1080)), k % 3 + 1).alias("current_resolution_height"),
    )


@query("""WITH last AS (SELECT max(event_timestamp) - INTERVAL 1 MINUTE AS wm FROM metric_events),
  o AS (SELECT *, CASE WHEN event_timestamp > lag(event_timestamp) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS opens FROM metric_events WINDOW w AS (PARTITION BY user_id, content_id ORDER BY event_timestamp, event_id)),
  s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id, content_id ORDER BY event_timestamp, event_id) AS k FROM o),
  g AS (SELECT user_id, content_id, k, count(*) AS beats, max(event_timestamp) AS final FROM s GROUP BY 1, 2, 3)
  SELECT user_id, content_id, count(*) AS sessions, sum(beats)::bigint AS beats FROM g, last WHERE final + INTERVAL 6 HOUR < wm GROUP BY 1, 2""")
def t4_heartbeat_sessions(spark, sf):
    out = E.run_once(E.playback_sessions(_beats(_stream(spark, sf)), 6 * 3600), spark, shared_folder(spark, "t4"))
    return out.groupBy("user_id", "content_id").agg(F.count("*").alias("sessions"), F.sum("beats").alias("beats"))


@query("SELECT event_type, ebvs, count(*) AS n FROM (SELECT event_type, (CASE WHEN event_type = 'error' THEN 0 ELSE floor(value * 1000) END) <= 0 AND (floor(value * 100) <= 0 OR floor(value * 100) > 10000) AS ebvs FROM metric_events) GROUP BY 1, 2")
def t6_ebvs_backfill(spark, sf):
    play = F.when(F.col("event_type") == "error", 0).otherwise(F.floor(F.col("value") * 1000))
    marked = _stream(spark, sf).select("event_type", E.ebvs_detected(play, F.floor(F.col("value") * 100)).alias("ebvs"))
    return E.run_once(marked, spark, shared_folder(spark, "t6")).groupBy("event_type", "ebvs").agg(F.count("*").alias("n"))


@query("SELECT event_type AS topic, count(*) AS n, round(sum(value), 2) AS total FROM metric_events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY 1")
def t7_route(spark, sf):
    folder = shared_folder(spark, "t7")
    paths = {k: f"{folder}/{k}" for k in ("click", "purchase", "view")}
    E.run_once(_stream(spark, sf), spark, folder, write=E.routed_write(paths))
    parts = [spark.read.parquet(p).select(F.lit(k).alias("topic"), "value") for k, p in paths.items()]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("topic").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 2)


def _guardrail(stream):
    own = stream.filter("event_type = 'error'").select((F.col("user_id") % 3).cast("string").alias("variant_id"), "value", "event_timestamp", F.lit("exp").alias("experiment_id"), F.lit("error").alias("metric_id"))
    return E.guardrail_windows(own, "event_timestamp", "value", ["experiment_id", "metric_id", "variant_id"], "12 hours")


_WINDOWS = "win AS (SELECT (user_id % 3)::varchar AS variant_id, time_bucket(INTERVAL 12 HOUR, event_timestamp) AS t, avg(value) AS v, count(*) AS n FROM metric_events WHERE event_type = 'error' GROUP BY 1, 2), wm AS (SELECT max(event_timestamp) - INTERVAL 1 HOUR AS wm FROM metric_events WHERE event_type = 'error'), fin AS (SELECT win.* FROM win, wm WHERE t + INTERVAL 12 HOUR <= wm)"
# checks that the tracker's own watermark has passed: an hour behind the youngest check
_COUNTED = _WINDOWS + ", due AS (SELECT * FROM fin WHERE t < (SELECT max(t) FROM fin))"


@query(f"WITH {_WINDOWS} SELECT variant_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS check_time, round(v, 6) AS current_value, n FROM fin")
def t8_guardrail_windows(spark, sf):
    out = E.run_once(_guardrail(_stream(spark, sf)), spark, shared_folder(spark, "t8"))
    return rounded(out.select("variant_id", F.date_format("check_time", "yyyy-MM-dd HH:mm:ss").alias("check_time"), "current_value", "n"))


@query(f"WITH {_COUNTED}, f AS (SELECT *, v > 50 AS b, sum((NOT v > 50)::int) OVER (PARTITION BY variant_id ORDER BY t) AS g FROM due), r AS (SELECT *, row_number() OVER (PARTITION BY variant_id, g ORDER BY t) AS run FROM f WHERE b) SELECT variant_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS check_time, round(v, 6) AS current_value, run::int AS run FROM r WHERE run = 3")
def t9_consecutive_breaches(spark, sf):
    folder = shared_folder(spark, "t9")
    checks = E.run_once(_guardrail(_stream(spark, sf)), spark, f"{folder}/checks")
    again = spark.readStream.schema(checks.schema).parquet(f"{folder}/checks/out")
    out = E.run_once(S.consecutive_breaches(again.drop("n"), 50.0, True, 3), spark, f"{folder}/alerts")
    return rounded(out.select("variant_id", F.date_format("check_time", "yyyy-MM-dd HH:mm:ss").alias("check_time"), "current_value", "run"))


@query(f"WITH {_COUNTED}, f AS (SELECT *, v > 50 AS b, sum((NOT v > 50)::int) OVER (PARTITION BY variant_id ORDER BY t) AS g FROM due), r AS (SELECT *, row_number() OVER (PARTITION BY variant_id, g ORDER BY t) AS run FROM f WHERE b) SELECT 'exp' AS key, 'error' AS metric_id, variant_id, round(v, 6) AS current_value, 3 AS consecutive_breach_count FROM r WHERE run = 3")
def s11_alert_sink(spark, sf):
    folder = shared_folder(spark, "s11")
    checks = E.run_once(_guardrail(_stream(spark, sf)), spark, f"{folder}/checks")
    again = spark.readStream.schema(checks.schema).parquet(f"{folder}/checks/out")
    sent = E.run_once(E.alert_messages(S.consecutive_breaches(again.drop("n"), 50.0, True, 3)), spark, f"{folder}/alerts")
    alert = F.from_json("value", "metric_id string, variant_id string, current_value double, consecutive_breach_count int").alias("a")
    return rounded(sent.select("key", alert).select("key", "a.*"))


@query("SELECT 'exp' AS experiment_id, (content_id % 4)::int AS arm_id, (1 + count(*) FILTER (value > 20))::double AS alpha, (1 + count(*) FILTER (value <= 20))::double AS beta, count(*) AS pulls FROM metric_events WHERE event_type IN ('click', 'purchase') GROUP BY 2")
def t10_running_posteriors(spark, sf):
    rewards = _stream(spark, sf).filter(F.col("event_type").isin("click", "purchase")).select(F.lit("exp").alias("experiment_id"), (F.col("content_id") % 4).alias("arm_id"), F.when(F.col("value") > 20, 1.0).otherwise(0.0).alias("reward"))
    return E.run_once(E.running_posteriors(rewards), spark, shared_folder(spark, "t10"), "complete")


_LATE = "ev AS (SELECT *, event_timestamp + INTERVAL 1 HOUR * (event_id * 37 % 7) AS arrived_at, content_id % 2 AS content FROM metric_events)"


@query(f"""WITH {_LATE}, last AS (SELECT max(event_timestamp) - INTERVAL 1 MINUTE AS wm FROM metric_events),
  m AS (SELECT *, coalesce(event_timestamp < max(event_timestamp) OVER (PARTITION BY user_id, content ORDER BY arrived_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM ev),
  g AS (SELECT *, CASE WHEN NOT late AND event_timestamp > lag(event_timestamp) OVER (PARTITION BY user_id, content, late ORDER BY arrived_at, event_id) + INTERVAL 24 HOUR THEN 1 ELSE 0 END AS opens FROM m),
  s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id, content ORDER BY arrived_at, event_id) AS k FROM g),
  n AS (SELECT user_id, content, k, count(*) FILTER (NOT late) AS beats, count(*) FILTER (late) AS dropped, max(event_timestamp) AS final, k = max(k) OVER (PARTITION BY user_id, content) AS newest FROM s GROUP BY 1, 2, 3)
  SELECT CASE WHEN newest THEN 'expiry' ELSE 'gap' END AS closed_by, count(*) AS sessions, sum(beats)::bigint AS beats, sum(dropped)::bigint AS out_of_order FROM n, last WHERE NOT newest OR final + INTERVAL 24 HOUR < wm GROUP BY 1""")
def t4_session_expiry(spark, sf):
    """Beats come up to six hours late: a session ends by a gap or by the sweep, and counts the beats that it dropped."""
    rows = _stream(spark, sf).withColumn("arrived_at", F.col("event_timestamp") + F.make_interval(hours=(F.col("event_id") * 37 % 7).cast("int")))
    beats = _beats(rows, "arrived_at").withColumns({"content_id": F.col("content_id") % 2})
    out = E.run_once(S.tracked_sessions(beats, 24 * 3600), spark, shared_folder(spark, "t4x"))
    return out.groupBy("closed_by").agg(F.count("*").alias("sessions"), F.sum("beats").alias("beats"), F.sum("out_of_order").alias("out_of_order"))


@query("""WITH o AS (SELECT user_id % 3 AS variant_id, value AS y, content_id::double AS x FROM metric_events), a AS (SELECT variant_id, count(*) AS n, avg(y) AS m, var_samp(y) AS v, avg(x) AS mx, var_samp(x) AS vx, covar_samp(x, y) AS cv FROM o GROUP BY 1),
  p AS (SELECT t.variant_id, t.n AS nt, c.n AS nc, t.m AS mt, c.m AS mc, t.v AS vt, c.v AS vc, t.mx AS mxt, c.mx AS mxc, t.vx AS vxt, c.vx AS vxc, t.cv AS ct, c.cv AS cc FROM a t, a c WHERE t.variant_id > 0 AND c.variant_id = 0),
  th AS (SELECT *, ((nt - 1) * ct + (nc - 1) * cc + nt * nc / (nt + nc) * (mt - mc) * (mxt - mxc)) / ((nt - 1) * vxt + (nc - 1) * vxc + nt * nc / (nt + nc) * pow(mxt - mxc, 2)) AS th FROM p)
  SELECT variant_id::varchar AS variant_id, round(mt - mc - th * (mxt - mxc), 5) AS effect, round(sqrt((vt - 2 * th * ct + th * th * vxt) / nt + (vc - 2 * th * cc + th * th * vxc) / nc), 5) AS se FROM th""")
def t11_online_sequential_test(spark, sf):
    obs = _stream(spark, sf).select((F.col("user_id") % 3).cast("string").alias("variant_id"), F.col("value").alias("y"), F.col("content_id").cast("double").alias("x"))
    sums = E.run_once(E.running_sums(obs, []), spark, shared_folder(spark, "t11"), "complete")
    return rounded(I.avlm(I.arm_pairs(E.moments_from_sums(sums), [], "0"), 0.5).select("variant_id", "effect", "se"), 5)


@query("""WITH o AS (SELECT (user_id % 3)::varchar AS variant_id, value + CASE WHEN user_id % 3 = 1 AND event_timestamp >= TIMESTAMP '2024-01-10' THEN 25 ELSE 0 END AS y, content_id::double AS x, time_bucket(INTERVAL 12 HOUR, event_timestamp) + INTERVAL 12 HOUR AS t FROM metric_events),
  wm AS (SELECT max(event_timestamp) - INTERVAL 1 HOUR AS wm FROM metric_events),
  w AS (SELECT variant_id, t, count(*) AS n, sum(y) AS sy, sum(x) AS sx, sum(y * y) AS syy, sum(x * y) AS sxy, sum(x * x) AS sxx FROM o GROUP BY 1, 2),
  looks AS (SELECT DISTINCT t FROM w, wm WHERE t <= wm),
  c AS (SELECT l.t, variant_id, sum(n) AS n, sum(sy) AS sy, sum(sx) AS sx, sum(syy) AS syy, sum(sxy) AS sxy, sum(sxx) AS sxx FROM looks l JOIN w ON w.t <= l.t GROUP BY 1, 2),
  a AS (SELECT t, variant_id, n, sy / n AS m, sx / n AS mx, (syy - sy * sy / n) / (n - 1) AS v, (sxx - sx * sx / n) / (n - 1) AS vx, (sxy - sx * sy / n) / (n - 1) AS cv FROM c WHERE n >= 2),
  p AS (SELECT t.t, t.variant_id, t.n AS nt, c.n AS nc, t.m AS mt, c.m AS mc, t.v AS vt, c.v AS vc, t.mx AS mxt, c.mx AS mxc, t.vx AS vxt, c.vx AS vxc, t.cv AS ct, c.cv AS cc FROM a t JOIN a c ON t.t = c.t AND c.variant_id = '0' AND t.variant_id <> '0'),
  h AS (SELECT *, ((nt - 1) * ct + (nc - 1) * cc + nt * nc / (nt + nc) * (mt - mc) * (mxt - mxc)) / ((nt - 1) * vxt + (nc - 1) * vxc + nt * nc / (nt + nc) * pow(mxt - mxc, 2)) AS th FROM p),
  e AS (SELECT *, mt - mc - th * (mxt - mxc) AS effect, sqrt((vt - 2 * th * ct + th * th * vxt) / nt + (vc - 2 * th * cc + th * th * vxc) / nc) AS se, 2.0 * nt * nc / (nt + nc) AS ne FROM h),
  b AS (SELECT *, se * sqrt(2 * (se * se * ne / 0.5 + ne) / ne * (ln(20) + 0.5 * ln(1 + ne / (se * se * ne / 0.5)))) AS half FROM e)
  SELECT variant_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS look_time, round(effect, 4) AS effect, round(half, 4) AS half_width, nt::bigint AS n_t, nc::bigint AS n_c FROM b WHERE abs(effect) > half QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY t) = 1""")
def t11_sequential_alerts(spark, sf):
    """Arm 1's values rise by 25 in the course of the stream: one alert, at the first look that its interval excludes 0."""
    variant = (F.col("user_id") % 3).cast("string")
    y = F.col("value") + F.when((variant == "1") & (F.col("event_timestamp") >= F.lit("2024-01-10").cast("timestamp")), 25.0).otherwise(0.0)
    obs = _stream(spark, sf).select(F.lit("exp").alias("experiment_id"), F.lit("value").alias("metric_id"), variant.alias("variant_id"), y.alias("y"), F.col("content_id").cast("double").alias("x"), "event_timestamp")
    out = E.run_once(S.sequential_alerts(obs, "event_timestamp", "0", 0.5, look="12 hours"), spark, shared_folder(spark, "t11x"))
    return rounded(out.select("variant_id", F.date_format("look_time", "yyyy-MM-dd HH:mm:ss").alias("look_time"), "effect", "half_width", "n_t", "n_c"), 4)


@query("SELECT event_type, 2 * count(*) AS rows, 2 * count(*) FILTER (NOT ok) AS rejected, count(*) FILTER (ok) AS accepted, count(*) FILTER (ok) AS duplicates, 90.0::double AS mean_delay_seconds FROM (SELECT event_type, value BETWEEN 0 AND 100 AND content_id BETWEEN 0 AND 97 AS ok FROM metric_events) GROUP BY 1")
def t12_stream_counts(spark, sf):
    """Every event arrives after a minute and again after two: the second of those that are valid is a duplicate."""
    twice = _stream(spark, sf).withColumn("minutes", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("arrived", F.col("event_timestamp") + F.make_interval(mins=F.col("minutes")))
    folder = shared_folder(spark, "t12")
    return rounded(E.count_stream(twice, spark, folder, E.failure_reason(**_REASON), "event_id", "event_timestamp", "arrived"))


@query("SELECT count(*) AS rows, count(*) FILTER (value BETWEEN 0 AND 100 AND content_id BETWEEN 0 AND 97) AS accepted FROM metric_events")
def t12_ingest_counts(spark, sf):
    from pyspark.sql import Observation

    reason = E.failure_reason(**_REASON)
    seen = Observation("ingest")
    V.metric_events(spark, sf).observe(seen, F.count("*").alias("rows"), F.count(F.when(reason.isNull(), 1)).alias("accepted")).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"], seen.get["accepted"])], "rows long, accepted long")


@query("""WITH RECURSIVE e AS (SELECT 'p' || (user_id % 5) AS program, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_timestamp, event_id::varchar) AS k, CASE WHEN user_id % 9 = 0 THEN 4000.0 ELSE 0.5 END AS e FROM metric_events, (SELECT max(event_timestamp) - INTERVAL 1 HOUR AS wm FROM metric_events) WHERE event_timestamp < wm),
  f(program, k, wealth, hits) AS (SELECT DISTINCT program, 0::bigint, 0.05::double, 0 FROM e UNION ALL SELECT f.program, f.k + 1,
    greatest(0, wealth - wealth * 0.1 * pow(0.9, f.k) + CASE WHEN e.e * wealth * 0.1 * pow(0.9, f.k) >= 1 THEN 0.05 ELSE 0 END), hits + CASE WHEN e.e * wealth * 0.1 * pow(0.9, f.k) >= 1 THEN 1 ELSE 0 END
    FROM f JOIN e ON e.program = f.program AND e.k = f.k + 1)
  SELECT program, max(k)::int AS tests, max(hits) AS rejections, round(arg_max(wealth, k), 9) AS wealth FROM f GROUP BY 1""")
def a18_online_fdr_stream(spark, sf):
    """Every event finishes a test; what is left after those that the watermark has passed."""
    tests = _stream(spark, sf).select(F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("program"), F.col("event_id").cast("string").alias("test_id"), F.col("event_timestamp").alias("finished_at"), F.when(F.col("user_id") % 9 == 0, 4000.0).otherwise(0.5).alias("e_value"))
    out = E.run_once(S.online_fdr_stream(tests, 0.05, 0.9), spark, shared_folder(spark, "a18"))
    return rounded(out.groupBy("program").agg(F.max("tests").alias("tests"), F.max("rejections").alias("rejections"), F.max_by("wealth", "tests").alias("wealth")), 9)
