"""Scans that take up only what changed, with their state in versioned tables.

Three tables under one folder: ``files`` (the last listing), ``findings`` (the
report as it stands) and ``history`` (first and last sighting per fingerprint).
The findings' commit carries the version of ``files`` it has processed, and the
history's that of ``findings``: a run that breaks off anywhere is taken up again
and nothing is scanned, carried or counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet.operators.state import updated_history
from driftnet.sources.versions import VersionedTable, content_changed, latest_by
from driftnet.storage import stored

FILES = "path string, mtime timestamp, size bigint, blob_hash string"
HISTORY = "fingerprint string, first_seen timestamp, last_seen timestamp"


class ScanState:
    """The state of repeated scans of one tree under ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.files = VersionedTable(spark, f"{self.path}/files", FILES)
        self.history = VersionedTable(spark, f"{self.path}/history", HISTORY)

    def _findings(self, schema) -> VersionedTable:  # noqa: ANN001
        return VersionedTable(self.spark, f"{self.path}/findings", schema)

    def listed(self, listing: DataFrame) -> int:
        """A new version of ``files``: ``listing(path, mtime, size[, blob_hash])``, each path by its latest mtime."""
        hashed = F.col("blob_hash").cast("string") if "blob_hash" in listing.columns else F.lit(None).cast("string")
        rows = listing.select(F.col("path").cast("string"), F.col("mtime").cast("timestamp"), F.col("size").cast("bigint"), hashed.alias("blob_hash"))
        return self.files.merge(latest_by(rows, "path", "mtime").select("path", "mtime", "size", "blob_hash"), "path", content_changed)

    def run(self, listing: DataFrame, scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The whole report after this run, with ``carried`` and ``is_new``.

        ``scan(paths)`` gives the findings (with source_path and fingerprint) of
        the files of ``paths(path)``; it is asked only about new and changed
        ones.  ``is_new`` marks fingerprints no earlier run has seen; it is
        computed per run and never stored.
        """
        version = self.listed(listing)
        table = self._findings(None)
        base = table.manifest()
        changes = stored(self.files.changes(base.processed.get("files", 0), version).select("path", "_change"), "changes")
        fresh = stored(scan(changes.where("_change = 'insert'").select("path")), "fresh")
        table = self._findings(fresh.schema)
        gone = changes.select(F.col("path").alias("source_path")).distinct()
        outdated = table.placed(base.version).join(gone, "source_path", "left_semi").select(F.col("_file").alias("file"), F.col("_row").alias("row")) if base.data else None
        at = table.commit(fresh, outdated, {"files": version}, base.version)
        report = table.read(at)
        known = stored(self.history.read().select("fingerprint").distinct(), "known")
        seen = report.select("fingerprint", F.current_timestamp().alias("seen_at"))
        self.history.merge(updated_history(self.history.read(), seen).drop("is_new"), "fingerprint", lambda a, b: ~F.col(f"{a}.last_seen").eqNullSafe(F.col(f"{b}.last_seen")), {"findings": at})
        paths = changes.where("_change = 'insert'").select(F.col("path").alias("source_path"), F.lit(True).alias("_fresh")).distinct()
        marked = report.join(paths, "source_path", "left").join(known.withColumn("_known", F.lit(True)), "fingerprint", "left")
        return marked.withColumns({"carried": F.col("_fresh").isNull(), "is_new": F.col("_known").isNull()}).select(*fresh.columns, "carried", "is_new")
