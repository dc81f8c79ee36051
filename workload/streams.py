"""Streams over the event log (survey group L).

Each stream reads the events table with ``availableNow`` and lands in Parquet; the SQL twin is the
same question asked of the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.functions.numbers import half_even
from maskloom.streaming import jobs as sj
from workload.registry import query
from workload.scratch import scratch


def _events(t):
    schema = t.read("events").schema
    return t.shape_job_events(sj.read_log(t.spark, t.sf_dir, "events.parquet", schema))


def _run(t, stream, name, mode="append"):
    out, checkpoint = scratch(t.spark, name), scratch(t.spark, f"{name}-state")
    sj.run_available(stream, out, checkpoint, mode)
    return t.spark.read.parquet(out)


@query("stream_job_state", """
WITH e AS (SELECT *, status IN ('completed', 'failed') AS done FROM job_events)
SELECT job_id, coalesce(arg_min(status, (ts, event_id)) FILTER (done), arg_max(status, (ts, event_id))) AS status,
  coalesce(arg_min(event_id, (ts, event_id)) FILTER (done), arg_max(event_id, (ts, event_id))) AS event_id FROM e GROUP BY job_id
""", "job_events")
def _state(t):
    return _run(t, sj.job_state(_events(t)), "state", "complete").select("job_id", "status", "event_id")


@query("stream_job_rates", """
SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, kind, status, count(*) AS n FROM job_events GROUP BY ALL
""", "job_events")
def _rates(t):
    rates = _run(t, sj.job_rates(_events(t)), "rates", "complete")
    return rates.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "kind", "status", "n")


@query("stream_progress", """
SELECT event_id, CASE WHEN kind = 'click' THEN 'running_inference' WHEN kind = 'view' THEN 'sampling_pixels' WHEN kind = 'purchase' THEN 'loading_annotations'
    WHEN kind = 'signup' THEN 'validating' ELSE 'running' END AS stage,
  coalesce(round_even(CASE WHEN kind = 'click' THEN least(greatest(k, 1), 80) / 80.0::DOUBLE * 0.7 + 0.2 WHEN kind = 'view' THEN least(greatest(k, 1), 80) / 80.0::DOUBLE * 0.42 + 0.22
    WHEN kind = 'purchase' THEN 0.12 WHEN kind = 'signup' THEN 0.84 END, 6), -1)::DOUBLE AS progress,
  CASE WHEN kind IN ('click', 'view') THEN least(greatest(k, 1), 80) || '/80 images' ELSE '-' END AS counter FROM job_events
""", "job_events")
def _progress(t):
    out = _run(t, sj.progress(_events(t)), "progress")
    return out.select(
        "event_id", "stage", F.coalesce(half_even(F.col("progress"), 6), F.lit(-1.0)).alias("progress"), F.coalesce("counter", F.lit("-")).alias("counter")
    )


@query("stream_heartbeat_stale", """
WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 180 SECOND OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opened FROM job_events WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opened) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS session FROM g)
SELECT job_id, arg_max(event_id, (ts, event_id)) AS last_event, count(*) AS events FROM s GROUP BY job_id, session HAVING arg_max(status, (ts, event_id)) = 'running'
""", "job_events")
def _stale(t):
    stale = _run(t, sj.stale_sessions(_events(t)), "stale", "complete")
    # Name each stale stretch by its last event: the one exactly one gap before it failed.
    ends = t.job_events.select("job_id", "event_id", (F.col("ts") + F.expr("INTERVAL 180 SECONDS")).alias("failed_at"))
    return stale.join(ends, ["job_id", "failed_at"]).groupBy("job_id", "session_start").agg(
        F.max("event_id").alias("last_event"), F.first("events").alias("events")
    ).select("job_id", "last_event", "events")


@query("stale_jobs", """
SELECT job_id FROM jobs WHERE status = 'running' AND epoch(TIMESTAMP '1998-01-01 00:00:00') - epoch(CAST(created_on AS TIMESTAMP)) > 180
""", "jobs")
def _stale_jobs(t):
    rows = t.jobs.withColumns({
        "heartbeat_at": F.lit(None).cast("timestamp"), "started_at": F.lit(None).cast("timestamp"), "created_at": F.col("created_on").cast("timestamp"),
    })
    return sj.stale_jobs(rows, "1998-01-01 00:00:00").select("job_id")


@query("stream_redelivery", "SELECT count(DISTINCT event_id) AS n FROM events")
def _redelivery(t):
    twice = _events(t).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _run(t, sj.redelivered_once(twice), "redelivery").agg(F.count("*").alias("n"))


@query("stream_dedupe", """
WITH e AS (SELECT event_id, job_id, CASE WHEN status = 'queued' THEN 1 WHEN status IN ('completed', 'failed') THEN -1 END AS step FROM job_events WHERE status <> 'running'),
p AS (SELECT *, lag(step) OVER (PARTITION BY job_id ORDER BY event_id) AS prev FROM e)
SELECT 'key-' || job_id AS dedupe_key, event_id FROM p WHERE step = 1 AND (prev IS NULL OR prev = -1)
""", "job_events")
def _dedupe(t):
    return _accepted(t, F.concat(F.lit("key-"), "job_id"))


@query("stream_dedupe_hot", """
WITH e AS (SELECT event_id, CASE WHEN job_id % 2 = 0 THEN 'hot' ELSE 'key-' || job_id END AS dedupe_key,
    CASE WHEN status = 'queued' THEN 1 WHEN status IN ('completed', 'failed') THEN -1 END AS step FROM job_events WHERE status <> 'running'),
p AS (SELECT *, lag(step) OVER (PARTITION BY dedupe_key ORDER BY event_id) AS prev FROM e)
SELECT dedupe_key, event_id FROM p WHERE step = 1 AND (prev IS NULL OR prev = -1)
""", "job_events")
def _dedupe_hot(t):
    return _accepted(t, F.when(F.col("job_id") % 2 == 0, "hot").otherwise(F.concat(F.lit("key-"), "job_id")))


def _accepted(t, key):
    """The log in four triggers of three files each, rows of a trigger in no order."""
    events, log = t.read("events"), scratch(t.spark, "dedupe-log")
    end = events.agg(F.max("event_id") + 1).first()[0]
    for at in range(4):
        part = events.where(f"event_id * 4 DIV {end} = {at}")
        part.repartition(3).write.mode("append").parquet(log)
    stream = t.shape_job_events(sj.read_log(t.spark, log, "*.parquet", events.schema, 3)).withColumn("dedupe_key", key)
    out = scratch(t.spark, "dedupe")
    sj.run_accepted(stream, out, scratch(t.spark, "dedupe-active"), scratch(t.spark, "dedupe-state"))
    return t.spark.read.parquet(out).select("dedupe_key", "event_id")


@query("stream_edits", """
SELECT image_id, sp_id, arg_max(class_id, seq) AS class_id, arg_max(mode, seq) AS mode FROM clicks GROUP BY ALL
""", "clicks")
def _edits(t):
    raw = sj.read_log(t.spark, t.sf_dir, "events.parquet", t.read("events").schema)
    clicks = raw.selectExpr(
        "event_id AS seq", "user_id AS image_id", "cast((event_id DIV 7) % 16 AS int) AS sp_id", "cast(1 + event_id % 3 AS int) AS class_id",
        "CASE event_type WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'undo' WHEN 'view' THEN 'redo' ELSE 'add' END AS mode",
    ).where("mode IN ('add', 'remove')")
    return _run(t, sj.current_edits(clicks), "edits", "complete")


@query("stream_image_arrivals", """
SELECT file_name, min(path) AS path FROM (SELECT 'up_' || doc_id // 2 || CASE WHEN doc_id % 6 < 4 THEN '.png' ELSE '.txt' END AS file_name,
  '/in/' || doc_id || '/up_' || doc_id // 2 || CASE WHEN doc_id % 6 < 4 THEN '.png' ELSE '.txt' END AS path FROM documents) d WHERE file_name LIKE '%.png' GROUP BY file_name
""")
def _arrivals(t):
    docs = sj.read_log(t.spark, t.sf_dir, "documents.parquet", t.read("documents").schema)
    files = docs.selectExpr("concat('/in/', doc_id, '/up_', doc_id DIV 2, IF(doc_id % 6 < 4, '.png', '.txt')) AS path")
    registry = scratch(t.spark, "arrivals")
    sj.register_arrivals(files, registry, scratch(t.spark, "arrivals-state"))
    return t.spark.read.parquet(registry).select("file_name", "path")


REQUESTS = "SELECT DISTINCT l_orderkey AS job_id FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1"


@query("cancel_propagate", f"""
SELECT j.job_id, CASE WHEN r.job_id IS NOT NULL AND status = 'queued' THEN 'canceled' ELSE status END AS status,
  r.job_id IS NOT NULL AND status IN ('queued', 'running') AS cancel_requested,
  CASE WHEN r.job_id IS NOT NULL AND status = 'queued' THEN 'canceled' WHEN r.job_id IS NOT NULL AND status = 'running' THEN 'cancel_requested' ELSE status END AS stage
FROM jobs j LEFT JOIN ({REQUESTS}) r ON r.job_id = j.job_id
""", "jobs")
def _cancel(t):
    asked = t.read("lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").selectExpr("l_orderkey AS job_id")
    return sj.cancel(t.jobs, asked).select("job_id", "status", "cancel_requested", "stage")


@query("cancel_entities", f"""
SELECT m.model_id, CASE WHEN m.model_id IN (SELECT entity_id FROM jobs j JOIN ({REQUESTS}) r ON r.job_id = j.job_id WHERE j.status = 'queued' AND j.entity_type = 'model')
  THEN 'canceled' ELSE m.status END AS status FROM models m
""", "jobs models")
def _cancel_entities(t):
    asked = t.read("lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").selectExpr("l_orderkey AS job_id")
    return sj.cancel_entities(sj.cancel(t.jobs, asked), t.models, "model", "model_id").select("model_id", "status")
