"""Scans over streams, and windows over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftnet.operators.scan import ScanOptions, scan
from driftnet.operators.state import updated_history
from driftnet.sources.versions import VersionedTable

HISTORY = "fingerprint string, first_seen timestamp, last_seen timestamp"


def blob_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet blobs as they arrive; the trigger bounds what is in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def scan_stream(blobs: DataFrame, out: str, checkpoint: str, options: ScanOptions = ScanOptions(), after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Findings of a stream of blobs, batch by batch, under ``out/batch=<id>``.

    A batch overwrites its own folder, so one that is repeated after a failure
    leaves the same result.  Stops when all available input is read."""
    def write(batch: DataFrame, number: int) -> None:
        found = scan(batch, options)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if after is not None:
            after(batch.sparkSession.read.parquet(f"{out}/batch={number}"), number)

    return blobs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history_keeper(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """An ``after`` that keeps first and last sightings in a versioned table, each batch once.

    The batch number is saved in the table's commit: a repeated batch is skipped."""
    table = VersionedTable(spark, path, HISTORY)

    def keep(found: DataFrame, number: int) -> None:
        if table.manifest().processed.get("batch", -1) >= number:
            return
        seen = found.select("fingerprint", F.current_timestamp().alias("seen_at"))
        new = updated_history(table.read(), seen).drop("is_new")
        table.merge(new, "fingerprint", lambda a, b: ~F.col(f"{a}.last_seen").eqNullSafe(F.col(f"{b}.last_seen")), {"batch": number})

    return keep


def unseen_files(files: DataFrame, prior: DataFrame) -> DataFrame:
    """Files of a stream (path, blob_hash) that a static table does not hold with the same hash."""
    return files.join(prior.select("path", "blob_hash").distinct(), ["path", "blob_hash"], "left_anti")


def severity_tally(findings: DataFrame) -> DataFrame:
    """Running counts per severity; for output mode complete."""
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark; event times without zone count in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event type and window of ``events(ts, event_type, value)``; late ones are dropped after ``late`` in a stream."""
    marked = _watermarked(events, late)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = marked.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users by gaps between events: user_id, session_start, session_end, n."""
    marked = _watermarked(events, late)
    out = marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
