"""Job, edit and upload logs as streams.

Every transformation takes a frame that may be streaming or not, so a batch run over the same log is
its own check.  Event rows: ``event_id, ts, job_id, status, message`` (plus what a job needs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.operators.ordering import previous_value
from maskloom.session import cut

# States that end a job, progress ranges and stages read from log text.
TERMINAL = ["completed", "failed", "canceled"]
SAMPLING, ANALYZING = r"sampling image\s+(\d+)\s*/\s*(\d+)", r"analyzing image\s+(\d+)\s*/\s*(\d+)"
STAGES = [
    ("loading coco annotations", "loading_annotations", 0.12), ("split images into", "sampling_pixels", 0.22),
    ("training randomforestclassifier", "training_model", 0.68), ("running validation", "validating", 0.84),
    ("saving artifacts", "saving_artifacts", 0.95), ("training complete", "training_complete", 0.98),
    ("loading model from", "loading_model", 0.12), ("writing outputs to", "preparing_outputs", 0.2),
]


def job_state(events: DataFrame) -> DataFrame:
    """State per job: the first terminal event sticks, else the latest event.

    Both are mergeable aggregates, so late and reordered rows give the same answer.
    """
    row = F.struct("status", "message", "ts", "event_id")
    at = F.struct("ts", "event_id")
    ended = F.col("status").isin(TERMINAL)
    states = events.groupBy("job_id").agg(
        F.min_by(F.when(ended, row), F.when(ended, at)).alias("_end"), F.max_by(row, at).alias("_last")
    )
    final = F.coalesce("_end", "_last")
    return states.select(
        "job_id", final["status"].alias("status"), final["message"].alias("message"), final["event_id"].alias("event_id")
    )


def job_rates(events: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Events per window, kind and status; rows later than the watermark are dropped."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("_w"), "kind", "status").agg(
        F.count("*").alias("n")
    ).select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "kind", "status", "n")


def progress(events: DataFrame) -> DataFrame:
    """Stage, fraction and image counter read from each log message: stateless.

    Image counters give 0.22 + 0.42·i/n while sampling and 0.2 + 0.7·i/n while analysing.
    """
    text = F.lower(F.trim("message"))

    def counter(pattern: str):
        current = F.regexp_extract(text, pattern, 1).try_cast("bigint")
        total = F.regexp_extract(text, pattern, 2).try_cast("bigint")
        whole = F.greatest(total, F.lit(1))
        return text.rlike(pattern), F.least(F.greatest(current, F.lit(1)), whole), whole

    sampling, s_at, s_all = counter(SAMPLING)
    analysing, a_at, a_all = counter(ANALYZING)
    stage, fraction = None, None
    for words, name, share in STAGES:
        hit = text.contains(words) if name == "loading_annotations" else text.startswith(words)
        stage = F.when(hit, name) if stage is None else stage.when(hit, name)
        fraction = F.when(hit, share) if fraction is None else fraction.when(hit, share)
    stage = stage.when(sampling, "sampling_pixels").when(analysing, "running_inference").otherwise("running")
    fraction = fraction.when(sampling, s_at / s_all * 0.42 + 0.22).when(analysing, a_at / a_all * 0.7 + 0.2)
    shown = F.when(sampling, F.concat(s_at, F.lit("/"), s_all, F.lit(" images"))).when(
        analysing, F.concat(a_at, F.lit("/"), a_all, F.lit(" images"))
    )
    return events.withColumns({"stage": stage, "progress": fraction, "counter": shown})


def stale_sessions(events: DataFrame, gap: str = "180 seconds", watermark: str = "1 hour") -> DataFrame:
    """Stretches of activity per job that ended without a terminal event: the job went stale.

    A session closes when no event came for ``gap``.
    """
    at = F.struct("ts", "event_id")
    sessions = events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("_w"), "job_id").agg(
        F.max_by("status", at).alias("last_status"), F.count("*").alias("events")
    )
    return sessions.where(F.col("last_status") == "running").select(
        "job_id", F.col("_w.start").alias("session_start"), F.col("_w.end").alias("failed_at"), "events"
    )


def stale_jobs(jobs: DataFrame, now, seconds: int = 180) -> DataFrame:
    """Running jobs whose heartbeat (else start, else creation) is more than ``seconds`` old."""
    beat = F.coalesce("heartbeat_at", "started_at", "created_at")
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(beat)
    return jobs.where((F.col("status") == "running") & (beat.isNull() | (age > seconds)))


def redelivered_once(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Drop redelivered events: same id within the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def accepted_jobs(events: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """One active job per key: ``dedupe_key, event_id, queued, accepted`` per queued or terminal event.

    A queued event is accepted when its key has no active job, so when the key's previous queued or
    terminal event is terminal or there is none; a terminal event frees the key.  ``active`` names the
    keys with a job still active from before.  ``events`` may lie in any order and one key may hold
    most of them.  Rows with a null key or id take no part.
    """
    queued = F.col("status") == "queued"
    steps = events.where(queued | F.col("status").isin(TERMINAL)).where(
        "dedupe_key IS NOT NULL AND event_id IS NOT NULL"
    ).select("dedupe_key", "event_id", queued.alias("queued"))
    after = previous_value(steps, ["dedupe_key"], ["event_id"], "queued", "_after")
    if active is not None:
        held = active.select("dedupe_key", F.lit(True).alias("_held"))
        after = after.join(held, "dedupe_key", "left").withColumn("_after", F.coalesce("_after", "_held"))
    return after.select(
        "dedupe_key", "event_id", "queued", (F.col("queued") & ~F.coalesce("_after", F.lit(False))).alias("accepted")
    )


def current_edits(clicks: DataFrame) -> DataFrame:
    """Live fold of clicks: the last one per superpixel."""
    return clicks.groupBy("image_id", "sp_id").agg(
        F.max_by(F.struct("class_id", "mode"), "seq").alias("_e")
    ).select("image_id", "sp_id", "_e.class_id", "_e.mode")


def cancel(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Cancellation: queued jobs are canceled at once, running ones get a flag, others stay."""
    asked = requests.select("job_id", F.lit(True).alias("_ask")).distinct()
    hit = F.coalesce("_ask", F.lit(False))
    queued, running = hit & (F.col("status") == "queued"), hit & (F.col("status") == "running")
    return jobs.join(asked, "job_id", "left").withColumns({
        "cancel_requested": queued | running,
        "stage": F.when(queued, "canceled").when(running, "cancel_requested").otherwise(F.col("status")),
        "status": F.when(queued, "canceled").otherwise(F.col("status")),
    }).drop("_ask")


def cancel_entities(canceled: DataFrame, entities: DataFrame, kind: str, key: str) -> DataFrame:
    """Entities (models or runs) of jobs canceled at once become canceled too."""
    gone = canceled.where((F.col("stage") == "canceled") & (F.col("entity_type") == kind)).select(
        F.col("entity_id").alias(key), F.lit(True).alias("_gone")
    ).distinct()
    return entities.join(gone, key, "left").withColumn(
        "status", F.when(F.col("_gone"), "canceled").otherwise(F.col("status"))
    ).drop("_gone")


# --- running ----------------------------------------------------------------------------------

def read_log(spark: SparkSession, folder: str, name: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream over a log: the Parquet files of that name in the folder, or those inside a folder of that name."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A pattern may stand for files and for folders; a plain path must be a folder.
    return reader.parquet(f"{folder}/{{{name}}}")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available and stop.

    Append goes straight to Parquet files.  Complete mode replaces the whole result per batch.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()


def run_accepted(stream: DataFrame, out: str, state: str, checkpoint: str) -> None:
    """``accepted_jobs`` over everything available; accepted ``dedupe_key, event_id`` go to ``out``.

    Batches must follow each other in log order.  Between them only the keys with an active job are
    kept, in one folder per batch; a batch that is replayed replaces its own folders.
    """
    def job(batch: DataFrame, batch_id: int) -> None:
        active = batch.sparkSession.read.schema("dedupe_key string").parquet(
            f"{state}/batch_id={batch_id - 1}"
        ) if batch_id > 0 else None
        steps = cut(accepted_jobs(batch, active))
        steps.where("accepted").select("dedupe_key", "event_id").write.mode("overwrite").parquet(
            f"{out}/batch_id={batch_id}"
        )
        last = steps.groupBy("dedupe_key").agg(F.max_by("queued", "event_id").alias("queued"))
        held = last.where("queued").select("dedupe_key")
        if active is not None:
            held = held.unionByName(active.join(last, "dedupe_key", "left_anti"))
        held.write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        job
    ).start().awaitTermination()


def register_arrivals(stream: DataFrame, registry: str, checkpoint: str) -> None:
    """Register arriving image files once per name.

    Each batch is written under its own ``batch_id=`` folder in overwrite mode, so a batch that is
    replayed after a failure replaces itself; names already registered by other batches drop out.
    """
    from maskloom.sources.images import scan_images

    columns = "file_name string, path string, batch_id bigint"

    def job(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = scan_images(batch).groupBy("file_name").agg(F.min("path").alias("path"))
        if batch_id > 0:
            known = spark.read.schema(columns).parquet(registry).where(F.col("batch_id") < batch_id)
            fresh = fresh.join(known.select("file_name"), "file_name", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{registry}/batch_id={batch_id}")

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        job
    ).start().awaitTermination()
