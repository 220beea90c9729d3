"""Relational work over findings: summaries, ranks, baselines, pairs, evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftnet.functions import text as tx

SEVERITIES = tuple(tx.SEVERITY_RANK)


def by_severity(findings: DataFrame) -> DataFrame:
    """severity, n for all five severities, zero where there is none; others are left out."""
    spark = findings.sparkSession
    all_ = spark.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    counts = findings.groupBy(F.lower("severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    return all_.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def by_rule(findings: DataFrame) -> DataFrame:
    """rule_id, n."""
    return findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def rollup(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts over every beginning of ``keys``; ``level`` is the number of keys summed over."""
    return findings.rollup(*keys).agg(F.count(F.lit(1)).alias("n"), F.grouping_id(*keys).alias("grouping")).withColumn("level", F.bit_count("grouping").cast("int")).drop("grouping")


def once(findings: DataFrame, by: Sequence[str] = ("line", "column_no")) -> DataFrame:
    """One row per fingerprint, the first by ``by``; null fingerprints are left out.

    A hash aggregate, so a fingerprint that holds a third of all rows collapses
    in every task before anything moves."""
    rest = [c for c in findings.columns if c != "fingerprint"]
    best = F.min(F.struct(*by, *(c for c in rest if c not in by)))
    return findings.where("fingerprint is not null").groupBy("fingerprint").agg(best.alias("_f")).select("fingerprint", *(F.col(f"_f.{c}").alias(c) for c in rest)).select(*findings.columns)


def by_path(findings: DataFrame, size: int = 1000) -> DataFrame:
    """Findings of each path as arrays of at most ``size``: logical_path, part, n, findings.

    Rows are numbered by hash within a path first, so that a path with a third
    of all rows spreads over parts instead of filling one array in one task."""
    parts = findings.groupBy("logical_path").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("_parts"))
    salted = findings.join(parts, "logical_path").withColumn("part", F.pmod(F.xxhash64("fingerprint", "line"), F.col("_parts")).cast("int"))
    return salted.groupBy("logical_path", "part").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("rule_id", "line", "fingerprint")).alias("findings"))


def report_order() -> list[Column]:
    """Most urgent first: tier, severity, confidence, then path and line."""
    return [F.desc(tx.actionability_rank(F.col("actionability"))), F.desc(tx.severity_rank(F.col("severity"))), F.desc("confidence"), F.asc("logical_path"), F.asc("line")]


def top(findings: DataFrame, n: int) -> DataFrame:
    """The first ``n`` in report order: each task keeps n rows, the driver merges them."""
    return findings.orderBy(*report_order(), "fingerprint").limit(n)


def ranked_in_blob(findings: DataFrame, blob: str = "logical_path") -> DataFrame:
    """``place`` of each finding in its blob by severity, confidence and line."""
    order = [F.desc(tx.severity_rank(F.col("severity"))), F.desc("confidence"), F.asc("line"), F.asc("fingerprint")]
    return findings.withColumn("place", F.row_number().over(Window.partitionBy(blob).orderBy(*order)))


def capped(findings: DataFrame, most: int, blob: str = "logical_path", order: Sequence[str] = ("line", "fingerprint")) -> DataFrame:
    """The first ``most`` findings of each blob.  Spark keeps only ``most`` rows per group and task
    before the shuffle (window group limit), so a blob with a third of all rows stays small."""
    return findings.withColumn("_n", F.row_number().over(Window.partitionBy(blob).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def without_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint the baseline does not hold; null fingerprints stay."""
    return findings.join(baseline.select("fingerprint").where("fingerprint is not null").distinct(), "fingerprint", "left_anti")


def nearest_pairs(left: DataFrame, right: DataFrame, by: str = "source_path", window: int = 40) -> DataFrame:
    """For each row of ``left(id, <by>, line)`` the nearest of ``right`` in the same group, if within ``window`` lines.

    Columns: id, partner, distance (ties: the smaller id).  A band join: lines
    are cut into bands of ``window`` and each right row enters three, so that a
    hot group spreads over its bands instead of being paired whole.
    """
    band = F.floor(F.col("line") / window)
    a = left.select("id", F.col(by).alias("g"), "line", band.alias("band"))
    b = right.select(F.col("id").alias("partner"), F.col(by).alias("g"), F.col("line").alias("other"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    near = a.where("g is not null and line is not null").join(b, ["g", "band"]).withColumn("distance", F.abs(F.col("line") - F.col("other"))).where(F.col("distance") <= window)
    return near.groupBy("id").agg(F.min(F.struct("distance", "partner")).alias("m")).select("id", "m.partner", "m.distance")


def near_truth(hits: DataFrame, truth: DataFrame, slack: int = 1) -> DataFrame:
    """Hits (path, line) with ``matched``: whether a truth line lies within ``slack`` lines.

    An equi-join: truth lines are spread to the lines around them first."""
    around = truth.select("path", F.explode(F.sequence(F.col("line") - slack, F.col("line") + slack)).alias("line")).where("path is not null").distinct().withColumn("_t", F.lit(True))
    return hits.join(around, ["path", "line"], "left").withColumn("matched", F.col("_t").isNotNull()).drop("_t")


def scores(hits: DataFrame, truth: DataFrame, negatives: DataFrame | None = None, slack: int = 1) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1.

    tp and fn count truth lines with and without a hit near them; fp counts hit
    lines that are near no truth line (of labelled negatives, if given)."""
    lines = hits.select("path", "line").where("path is not null and line is not null").distinct()
    real = truth.select("path", "line").where("path is not null and line is not null").distinct()
    found = near_truth(real, lines, slack).agg(F.count_if("matched").alias("tp"), F.count_if(~F.col("matched")).alias("fn"))
    judged = lines if negatives is None else lines.join(negatives.select("path", "line").distinct(), ["path", "line"], "left_semi")
    wrong = near_truth(judged, real, slack).agg(F.count_if(~F.col("matched")).alias("fp"))
    one = found.withColumn("_k", F.lit(1)).join(wrong.withColumn("_k", F.lit(1)), "_k").drop("_k")  # two single rows
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return one.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def copies_scanned_once(blobs: DataFrame, key: str = "text") -> DataFrame:
    """One blob per content with ``n_copies`` and the first path: scan these, join findings back by ``content_hash``."""
    hashed = blobs.where(F.col(key).isNotNull()).withColumn("content_hash", F.sha2(F.col(key).cast("binary"), 256))
    return hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_copies"), F.min("logical_path").alias("logical_path"))


def truth_lines(spark: SparkSession, path: str) -> DataFrame:
    """Labelled lines from CSV files with FilePath, LineStart, LineEnd, GroundTruth: path, line, label."""
    raw = spark.read.option("header", True).csv(path)
    span = F.sequence(F.col("LineStart").cast("int"), F.greatest(F.col("LineEnd").cast("int"), F.col("LineStart").cast("int")))
    return raw.where("LineStart is not null").select(F.col("FilePath").alias("path"), F.explode(span).alias("line"), F.col("GroundTruth").alias("label"))
