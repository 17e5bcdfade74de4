"""Streams: texts into the snapshot store, job events into current states, late arrivals by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators.chunking import TARGET
from paperloom.operators.jobs import fold_jobs
from paperloom.operators.store import SnapshotStore
from paperloom.plans.ingest import ingest_texts
from paperloom.plans.worker import Worker
from paperloom.session import shared

TEXTS = "document_key string, public_id string, source string, source_id string, title string, text string, loaded_at timestamp"
EVENTS = "job string, at timestamp, event_id long, status string, reported double, warning string, error string"


def stream_texts(spark: SparkSession, folder: str, store: SnapshotStore, checkpoint: str, target: int = TARGET, separator: str = "\f", every: str | None = None) -> StreamingQuery:
    """Ingests Parquet files of texts as they arrive. A batch replaces what its documents had, so a batch that is
    delivered again after a failure changes nothing. `every` polls (for example `2 seconds`); without it all there is
    is taken and the query ends."""

    def batch(df: DataFrame, _: int) -> None:
        rows = df.filter("document_key IS NOT NULL AND text IS NOT NULL")
        others = [c for c in rows.columns if c != "document_key"]
        last = rows.groupBy("document_key").agg(F.max_by(F.struct(*others), F.struct("loaded_at", "text")).alias("_r")).select("document_key", *[F.col(f"_r.{c}").alias(c) for c in others])
        if not last.isEmpty():
            ingest_texts(store, last.drop("text", "loaded_at"), last.select("document_key", "text"), target, separator)

    writer = spark.readStream.schema(TEXTS).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stream_jobs(spark: SparkSession, folder: str, store: SnapshotStore, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keeps the tables job_events (each event once) and jobs (current states) from files of events. A batch reads and
    writes the buckets of its jobs only."""

    def batch(df: DataFrame, _: int) -> None:
        keys = df.select("job").filter("job IS NOT NULL").distinct()
        if keys.isEmpty():
            return
        fresh = df.filter("job IS NOT NULL").dropDuplicates(["event_id"])
        if store.has("job_events"):
            known = store.read("job_events").join(keys, "job", "left_semi")
            fresh = known.unionByName(fresh.join(known.select("event_id"), "event_id", "left_anti").select(*known.columns))
        events = shared(fresh)
        store.commit_keys({"job_events": (events, keys), "jobs": (fold_jobs(events), keys)}, "job")

    writer = spark.readStream.schema(EVENTS).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def arrivals(events: DataFrame, watermark: str = "30 days", window: str = "1 day") -> DataFrame:
    """Events per window of their own time and kind, rows later than the watermark dropped; for batch and stream alike."""
    kept = events.withWatermark("at", watermark)
    return kept.groupBy(F.window("at", window).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def stream_worker(spark: SparkSession, worker: Worker, checkpoint: str, every: str = "2 seconds", n: int = 20) -> StreamingQuery:
    """Polls the queue and runs what can be claimed until the query is stopped."""

    def batch(df: DataFrame, _: int) -> None:
        worker.run_until_idle(n)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
