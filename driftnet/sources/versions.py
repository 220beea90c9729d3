"""Problem 4: processing only new or changed records, by table versions.

A versioned table is a folder of immutable Parquet files, deletion vectors
(which rows of which file are gone) and one small manifest per version.  Two
manifests are compared instead of two tables: files only the newer one lists
hold the added records, new deletion vectors name the removed ones; files in
both are never opened.  A consumer saves the version it has processed inside
its own output commit, so a run that breaks off leaves either both or neither.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionConflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Manifest:
    """One version: its data folders and deletion vectors, and what its writer had processed."""

    version: int
    data: tuple[str, ...] = ()
    vectors: tuple[str, ...] = ()
    processed: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    """An append-and-delete table under ``path`` with one manifest per version.

    A version becomes visible with its manifest file, which is created
    exclusively; folders a broken run left behind are in no manifest and so are
    never read.  ``schema`` (a DDL string or StructType) is needed to read a
    table that has no version yet.
    """

    def __init__(self, spark: SparkSession, path: str, schema=None) -> None:  # noqa: ANN001
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    # -- files, through Hadoop so any shared file system will do
    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def latest(self) -> int:
        """The newest version, 0 if there is none."""
        fs, folder = self._fs(f"{self.path}/_versions")
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.latest() if version is None else version
        if version == 0:
            return Manifest(0)
        fs, file = self._fs(f"{self.path}/_versions/{version}.json")
        stream = fs.open(file)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        raw = json.loads(text)
        return Manifest(raw["version"], tuple(raw["data"]), tuple(raw["vectors"]), raw["processed"])

    def _publish(self, new: Manifest) -> None:
        body = json.dumps({"version": new.version, "data": new.data, "vectors": new.vectors, "processed": new.processed})
        fs, draft = self._fs(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(body, "utf-8"))
        stream.close()
        final = self._fs(f"{self.path}/_versions/{new.version}.json")[1]
        # A rename onto an existing file fails: two writers cannot both make a version.
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise VersionConflict(f"version {new.version} of {self.path} exists")

    def commit(self, added: DataFrame | None = None, removed: DataFrame | None = None, processed: dict[str, int] | None = None, parent: int | None = None) -> int:
        """A new version: ``added`` rows and deletion vectors ``removed`` (file, row)."""
        base = self.manifest(parent)
        data, vectors = list(base.data), list(base.vectors)
        if added is not None:
            folder = f"data/{base.version + 1}-{uuid.uuid4().hex}"
            added.write.parquet(f"{self.path}/{folder}")
            data.append(folder)
        if removed is not None:
            folder = f"vectors/{base.version + 1}-{uuid.uuid4().hex}"
            removed.select(F.col("file").cast("string"), F.col("row").cast("bigint")).write.parquet(f"{self.path}/{folder}")
            vectors.append(folder)
        self._publish(Manifest(base.version + 1, tuple(data), tuple(vectors), {**base.processed, **(processed or {})}))
        return base.version + 1

    def _rows(self, folders: tuple[str, ...]) -> DataFrame:
        """Rows of data folders with ``_file`` and ``_row``, their place."""
        if not folders:
            if self.schema is None:
                raise ValueError(f"{self.path} has no version and no schema was given")
            empty = self.spark.createDataFrame([], self.schema)
            return empty.withColumns({"_file": F.lit(None).cast("string"), "_row": F.lit(None).cast("bigint")})
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        frame = reader.parquet(*(f"{self.path}/{f}" for f in folders))
        return frame.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def _vectors(self, folders: tuple[str, ...]) -> DataFrame | None:
        if not folders:
            return None
        return self.spark.read.schema("file string, row bigint").parquet(*(f"{self.path}/{f}" for f in folders)).distinct()

    def placed(self, version: int | None = None) -> DataFrame:
        """The table at a version with ``_file`` and ``_row``."""
        at = self.manifest(version)
        rows, gone = self._rows(at.data), self._vectors(at.vectors)
        if gone is None:
            return rows
        return rows.join(gone, (rows["_file"] == gone["file"]) & (rows["_row"] == gone["row"]), "left_anti")

    def read(self, version: int | None = None) -> DataFrame:
        return self.placed(version).drop("_file", "_row")

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """Record deltas between two versions, with ``_change`` insert or delete.

        Only manifests are compared: rows of folders added since then that no
        vector has removed again are inserts, rows of older folders that a new
        vector names are deletes.  Unchanged files are not opened for inserts;
        for deletes only files the new vectors name give rows.
        """
        old, new = self.manifest(since), self.manifest(until)
        fresh = tuple(f for f in new.data if f not in old.data)
        new_vectors = tuple(v for v in new.vectors if v not in old.vectors)
        inserts = self._rows(fresh)
        gone = self._vectors(new_vectors)
        if gone is not None:
            inserts = inserts.join(gone, (inserts["_file"] == gone["file"]) & (inserts["_row"] == gone["row"]), "left_anti")
        out = inserts.withColumn("_change", F.lit("insert"))
        if gone is not None and old.data:
            rows = self._rows(old.data)
            deletes = rows.join(gone, (rows["_file"] == gone["file"]) & (rows["_row"] == gone["row"]), "left_semi")
            out = out.unionByName(deletes.withColumn("_change", F.lit("delete")))
        return out.drop("_file", "_row")

    def merge(self, snapshot: DataFrame, key: str, changed: Callable[[str, str], Column], processed: dict[str, int] | None = None, remove_missing: bool = True) -> int:
        """Make the table equal to ``snapshot`` (unique non-null ``key``) in one commit.

        ``changed(old, new)`` says, given the two column prefixes, whether a row
        differs; rows that do not keep their old place.  The join is computed
        once and stored, so the two writes agree even if tasks are retried.
        """
        base = self.latest()
        names = [c for c in snapshot.columns if c != key]
        old = self.placed(base)
        old = old.select(F.col(key).alias("_key"), F.struct(*(F.col(c) for c in names), "_file", "_row").alias("old"))
        new = snapshot.select(F.col(key).alias("_key"), F.struct(*(F.col(c) for c in names)).alias("new"))
        both = old.join(new, "_key", "full_outer" if remove_missing else "right_outer")
        differs = F.col("old").isNull() | F.col("new").isNull() | changed("old", "new")
        from driftnet.storage import stored

        delta = stored(both.where(differs), "merge")
        added = delta.where("new is not null").select(F.col("_key").alias(key), "new.*").select(*snapshot.columns)
        removed = delta.where("old is not null").select(F.col("old._file").alias("file"), F.col("old._row").alias("row"))
        return self.commit(added, removed, processed, base)


def process_changes(source: VersionedTable, output: VersionedTable, work: Callable[[DataFrame], DataFrame], name: str = "source") -> tuple[int, int]:
    """Run ``work`` over the records added or changed since the last success.

    The processed version of ``source`` is saved in the manifest of the output
    commit: if the run breaks off, neither is visible and the next run takes the
    same changes up again; after it, they are never repeated.  The commit builds
    on the output version that was read at the start: of two runs at a time one
    gets a VersionConflict and leaves nothing.  Returns the versions processed
    (from, to).
    """
    base = output.manifest()
    done, until = base.processed.get(name, 0), source.latest()
    if until > done:
        output.commit(work(source.changes(done, until)), None, {name: until}, base.version)
    return done, until


def latest_by(frame: DataFrame, key: str, by: str) -> DataFrame:
    """Per non-null key the row with the greatest ``by`` (nulls first, ties by the other columns).

    One aggregate with map-side combine: repeats of a hot key collapse early.
    """
    rest = [c for c in frame.columns if c not in (key, by)]
    best = F.max(F.struct(F.col(by), *(F.col(c) for c in rest)))
    return frame.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("_best")).select(key, f"_best.{by}", *(f"_best.{c}" for c in rest))


def file_state(files: DataFrame, runs: DataFrame) -> DataFrame:
    """path, mtime, size, blob_hash as the successful runs left them.

    A run is successful only if its state is ``ok``; the latest row by
    scanned_at wins.  Rows without path or with the id of no successful run are
    left out.
    """
    good = runs.where(F.col("state") == "ok").select("run_id").distinct()
    rows = files.join(good, "run_id", "left_semi").select("path", "scanned_at", "mtime", "size", "blob_hash")
    return latest_by(rows, "path", "scanned_at").drop("scanned_at")


def listing_state(listing: DataFrame) -> DataFrame:
    """path, mtime, size, blob_hash of the latest listing of each path."""
    return latest_by(listing.select("path", "listed_at", "mtime", "size", "blob_hash"), "path", "listed_at").drop("listed_at")


def content_changed(old: str, new: str) -> Column:
    """Whether a file differs: by hash, or by mtime and size where a hash is missing."""
    a, b = (F.col(f"{old}.blob_hash"), F.col(f"{new}.blob_hash"))
    touched = ~F.col(f"{old}.mtime").eqNullSafe(F.col(f"{new}.mtime")) | ~F.col(f"{old}.size").eqNullSafe(F.col(f"{new}.size"))
    return F.when(a.isNull() | b.isNull(), touched).otherwise(a != b)


def recorded_files(files: DataFrame, runs: DataFrame, path: str) -> VersionedTable:
    """A versioned table of file states whose first version is what the successful runs left."""
    table = VersionedTable(files.sparkSession, path, "path string, mtime timestamp, size bigint, blob_hash string")
    if table.latest() == 0:
        table.commit(file_state(files, runs), parent=0)
    return table


def list_files(table: VersionedTable, listing: DataFrame, remove_missing: bool = True) -> int:
    """The next version of a table of file states: a listing.

    A listing is a whole snapshot, so one join by path finds the rows that
    differ: they become a data folder and deletion vectors, all others stay in
    the files they are in.  ``remove_missing`` drops paths that are not listed."""
    return table.merge(listing_state(listing), "path", content_changed, remove_missing=remove_missing)


def take_up(table: VersionedTable, output: VersionedTable, work: Callable[[DataFrame], DataFrame] = lambda d: d, recorded: int = 1) -> tuple[int, int]:
    """One run over the paths that are new or changed since the last run that succeeded.

    The first ``recorded`` versions of ``table`` count as processed before the
    first run.  ``work`` gets the records to take up (path, mtime, size,
    blob_hash), each path once, from the manifests' difference; its result and
    the processed version become visible in one commit.  A run that breaks off
    leaves nothing, and the next takes the same records up again.
    """
    if output.latest() == 0:
        output.commit(processed={"files": recorded}, parent=0)
    return process_changes(table, output, lambda d: work(d.where("_change = 'insert'").drop("_change")), "files")


def file_deltas(files: DataFrame, runs: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """Deltas of the listing against the recorded files, by table versions under ``path``.

    Version 1 is the state the successful runs left, version 2 the listing; the
    difference of their manifests gives the records to take up (insert: new or
    changed, each path once) and the outdated ones (delete).
    """
    table = recorded_files(files, runs, path)
    list_files(table, listing)
    return table.changes(1, 2)
