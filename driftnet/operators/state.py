"""State between runs: skipped files, carried findings, history, cached verdicts.

State tables are Parquet; an update is a full outer join whose result replaces
the table in one commit (see sources.versions for versioned tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_unchanged(current: DataFrame, prior: DataFrame) -> DataFrame:
    """``current(path, blob_hash)`` with ``unchanged``: whether the prior run saw the same hash.

    A null hash on either side is never unchanged; repeated paths of ``prior`` count by any of their hashes."""
    known = prior.select("path", "blob_hash").where("path is not null and blob_hash is not null").distinct().withColumn("_k", F.lit(True))
    return current.join(known, ["path", "blob_hash"], "left").withColumn("unchanged", F.col("_k").isNotNull()).drop("_k")


def carried(findings: DataFrame, unchanged: DataFrame) -> DataFrame:
    """Stored findings of paths that were skipped, marked ``carried``."""
    paths = unchanged.where("unchanged").select(F.col("path").alias("source_path")).distinct()
    return findings.join(paths, "source_path", "left_semi").withColumn("carried", F.lit(True))


def complete_report(fresh: DataFrame, stored_findings: DataFrame, unchanged: DataFrame) -> DataFrame:
    """Fresh findings and those carried forward: the whole state of the scanned tree."""
    return fresh.withColumn("carried", F.lit(False)).unionByName(carried(stored_findings, unchanged), allowMissingColumns=True)


def rehydrated(redacted: DataFrame, detected: DataFrame) -> DataFrame:
    """Rows whose secret was stored redacted, with secret, context and key of a new detection at the same place."""
    keys = ["rule_id", "logical_path", "line", "column_no"]
    new = detected.groupBy(*keys).agg(F.min(F.struct("secret", "match_context", "key_name")).alias("_n"))
    joined = redacted.join(new, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_n.{c}"), F.col(c)) for c in ("secret", "match_context", "key_name")}).drop("_n")


def updated_history(history: DataFrame, seen: DataFrame) -> DataFrame:
    """History (fingerprint, first_seen, last_seen) after ``seen(fingerprint, seen_at)``, with ``is_new``.

    Both sides are aggregated first, so a hot fingerprint joins as one row."""
    old = history.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("first_seen").alias("o_first"), F.max("last_seen").alias("o_last"))
    new = seen.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("seen_at").alias("n_first"), F.max("seen_at").alias("n_last"))
    both = old.join(new, "fingerprint", "full_outer")
    known = F.col("o_first").isNotNull() | F.col("o_last").isNotNull()
    return both.select("fingerprint", F.when(known, F.col("o_first")).otherwise(F.col("n_first")).alias("first_seen"), F.greatest("o_last", "n_last").alias("last_seen"), (~known).alias("is_new"))


def new_and_known(history: DataFrame, seen: DataFrame) -> DataFrame:
    """n_new, n_known among the distinct fingerprints of ``seen``."""
    known = history.select("fingerprint").distinct().withColumn("_k", F.lit(True))
    marked = seen.select("fingerprint").where("fingerprint is not null").distinct().join(known, "fingerprint", "left")
    return marked.agg(F.count_if(F.col("_k").isNull()).alias("n_new"), F.count_if(F.col("_k").isNotNull()).alias("n_known"))


def secret_key(column: str = "secret"):  # noqa: ANN201
    return F.sha2(F.col(column).cast("binary"), 256)


def with_cached_verdicts(findings: DataFrame, cache: DataFrame) -> DataFrame:
    """Findings with ``verified`` and ``verification_note`` of the cache (secret_hash, verdict, note); latest first."""
    latest = cache.where("secret_hash is not null").groupBy("secret_hash").agg(F.max_by(F.struct("verdict", "note"), F.col("checked_at")).alias("_v"))
    keyed = findings.withColumn("secret_hash", secret_key())
    joined = keyed.join(latest, "secret_hash", "left")
    return joined.withColumns({"verified": F.coalesce("_v.verdict", F.lit("unknown")), "verification_note": F.col("_v.note")}).drop("_v")


def upserted(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those with the same key."""
    return table.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes)
