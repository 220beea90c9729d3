"""Reports of findings: JSON, SARIF, a table, an exit code."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet.functions import entropy, parse, validate
from driftnet.functions import text as tx
from driftnet.operators.findings import by_rule, by_severity, report_order
from driftnet.operators.scan import rule_matches, token_matches
from driftnet.plans.rules import BUILT_IN

# Levels and scores of severities in SARIF 2.1.0.
LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SCORE = {"critical": "9.5", "high": "8.0", "medium": "5.5", "low": "3.0", "info": "1.0"}


def _lookup(severity: Column, table: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, value in table.items():
        out = out.when(F.lower(severity) == name, value)
    return out


def redacted(findings: DataFrame) -> DataFrame:
    """``findings`` with secret, secret_v2 and match_context redacted.

    A context shows the values of its neighbours too, so it is searched with every
    rule, for long random tokens and for values of sensitive keys, and all that is
    found is scrubbed, longest first, with the finding's own values whatever their
    length.  Nulls stay null; columns that are not there are not made; a row stays
    a row.  (A scan with ``redact`` hides neighbours by their places instead.)
    """
    has_context, names = "match_context" in findings.columns, list(findings.columns)
    second = F.split("secret_v2", ":") if "secret_v2" in names else F.array().cast("array<string>")
    out = findings
    if has_context:
        # Every rule reads the columns text, lowered and logical_path: they are made beside the row.
        row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row")
        rows = findings.select(row, F.col("match_context").alias("text"), F.lower("match_context").alias("lowered"), F.lit("").alias("logical_path"),
                               F.array_compact(F.concat(F.array(F.col("secret")), F.coalesce(second, F.array().cast("array<string>")))).alias("_own"))
        lines = F.replace(F.col("text"), F.lit(" ⏎ "), F.lit("\n"))
        keyed = F.filter(F.concat(parse.env_pairs(lines), parse.properties_pairs(lines)), lambda p: validate.sensitive_key(p["key_path"]) & (F.length(p["value"]) >= 6))
        random = F.filter(token_matches(), lambda t: entropy.shannon(t["secret"]) >= entropy.threshold(entropy.charset(t["secret"]), F.lit(False)))
        values = F.concat(F.transform(rule_matches(BUILT_IN), lambda h: h["secret"]), F.transform(random, lambda t: t["secret"]), F.transform(keyed, lambda p: p["value"]))
        own = F.aggregate(F.array_sort(F.col("_own"), lambda a, b: F.length(b) - F.length(a)), tx.scrub(F.col("text"), F.array_union(F.col("_own"), values)),
                          lambda t, s: F.when(s == "", t).otherwise(F.replace(t, s, tx.redact(s))))
        out = rows.withColumn("_shown", F.when(F.col("text").isNotNull(), own)).select("_row.*", "_shown").withColumn("match_context", F.col("_shown")).drop("_shown")
    return out.withColumns({c: tx.redact(F.col(c)) for c in ("secret", "secret_v2") if c in names}).select(*(f"`{c}`" for c in names))


# Known values are found in a context by so many first characters; of few values each is sought by itself.
START, FEW = 8, 16


def _count_shown(batches):  # noqa: ANN001, ANN202
    """n, n_contexts, n_secrets, n_leaks of rows sorted by path: a path's known values first, then its contexts."""
    import pyarrow as pa

    n = n_contexts = n_secrets = n_leaks = 0
    path, last, values, lengths = None, None, set(), defaultdict(set)
    for batch in batches:
        for at, is_context, value, has_secret in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != path:
                path, last, values, lengths = at, None, set(), defaultdict(set)
            if not is_context:
                n, n_secrets = n + 1, n_secrets + has_secret
                if value is not None and at is not None:
                    values.add(value)
                    lengths[value[:START]].add(len(value))
                continue
            n_contexts += value is not None
            if value is None or at is None or value == last:  # equal contexts of a path stand together and count once
                continue
            last = value
            if len(values) <= FEW:
                n_leaks += sum(v in value for v in values)
            else:
                begins = ((i, lengths.get(value[i:i + START], ())) for i in range(len(value) - START + 1))
                n_leaks += len({v for i, sizes in begins for size in sizes if (v := value[i:i + size]) in values})
    yield pa.RecordBatch.from_pydict({"n": [n], "n_contexts": [n_contexts], "n_secrets": [n_secrets], "n_leaks": [n_leaks]})


def shown_values(shown: DataFrame) -> DataFrame:
    """One row over redacted findings: n, n_contexts, n_secrets, n_leaks, the contexts that show a known value of their path, for each value.

    ``shown`` has logical_path, secret, match_context and known, a value in clear of
    ``START`` characters or more, or null.  Values and contexts meet by one shuffle
    of each row, whatever the number of either on a path, and work grows with their
    length; a task holds the distinct values of one path.  Rows without a path meet none.
    """
    parts = F.stack(F.lit(2), F.lit(False), F.col("known"), F.col("secret").isNotNull(), F.lit(True), F.col("match_context"), F.lit(False))
    rows = shown.select("logical_path", parts.alias("is_context", "value", "has_secret")).select("logical_path", "is_context", "value", "has_secret")
    dealt = rows.repartition("logical_path", F.when(F.col("logical_path").isNull(), F.xxhash64("value"))).sortWithinPartitions("logical_path", "is_context", "value")
    counts = dealt.mapInArrow(_count_shown, "n bigint, n_contexts bigint, n_secrets bigint, n_leaks bigint")
    return counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns))


def json_rows(findings: DataFrame, hide: bool = True) -> DataFrame:
    """One JSON document per finding, secrets redacted unless they are already."""
    shown = redacted(findings) if hide else findings
    return shown.select("fingerprint", F.to_json(F.struct(*(c for c in shown.columns))).alias("document"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result per finding: rule_id, level, security_severity, uri, line, fingerprint, result (JSON)."""
    uri = F.regexp_replace(F.translate(F.col("logical_path"), "\\", "/"), " ", "%20")
    place = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    level = _lookup(F.col("severity"), LEVEL)
    body = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.concat_ws(" in ", "rule_id", "logical_path").alias("text")).alias("message"), F.array(place).alias("locations"),
                    F.struct(F.col("fingerprint").alias("secretIdentity/v1")).alias("partialFingerprints"))
    return findings.select("rule_id", level.alias("level"), _lookup(F.col("severity"), SCORE).alias("security_severity"), uri.alias("uri"), F.greatest("line", F.lit(1)).alias("line"), "fingerprint", F.to_json(body).alias("result"))


def write_sarif(findings: DataFrame, path: str, tool: str = "driftnet") -> None:
    """A SARIF file per partition under ``path``; every file is a whole document of its results.

    No task gathers all findings: consumers merge runs, as SARIF allows several."""
    results = sarif_results(findings).select("result")

    def documents(batches):  # noqa: ANN001, ANN202
        import json

        import pandas as pd

        for batch in batches:
            if len(batch):
                rows = [json.loads(r) for r in batch["result"]]
                rules = [{"id": r} for r in sorted({x["ruleId"] for x in rows})]
                run = {"tool": {"driver": {"name": tool, "rules": rules}}, "results": rows}
                yield pd.DataFrame({"value": [json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]})]})

    results.mapInPandas(documents, "value string").write.text(path)


def summary(findings: DataFrame) -> DataFrame:
    """kind (total, severity, rule), name, n."""
    total = findings.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("kind"), F.lit("").alias("name"), "n")
    return total.unionByName(by_severity(findings).select(F.lit("severity").alias("kind"), F.col("severity").alias("name"), "n")) \
        .unionByName(by_rule(findings).select(F.lit("rule").alias("kind"), F.coalesce("rule_id", F.lit("")).alias("name"), "n"))


def table_text(findings: DataFrame, rows: int = 50, hide: bool = True) -> str:
    """The first rows in report order as text, secrets redacted unless they are already."""
    secret = tx.redact(F.col("secret")) if hide else F.col("secret")
    shown = findings.orderBy(*report_order()).limit(rows).select("severity", "rule_id", tx.short_path(F.col("logical_path")).alias("path"), "line", secret.alias("secret"), "confidence").collect()
    head = ("severity", "rule", "path", "line", "secret", "confidence")
    cells = [head, *(tuple(str(x) for x in r) for r in shown)]
    width = [max(len(r[i]) for r in cells) for i in range(len(head))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip() for r in cells)


def exit_code(findings: DataFrame, fail_on: str = "high") -> int:
    """1 if any finding is as severe as ``fail_on`` or more; stops at the first."""
    return int(not findings.where(tx.severity_rank(F.col("severity")) >= tx.SEVERITY_RANK[fail_on]).limit(1).isEmpty())


def write_report(findings: DataFrame, path: str) -> None:
    """Redacted findings as Parquet, one folder per scan date."""
    redacted(findings).withColumn("scan_date", F.current_date()).write.mode("append").partitionBy("scan_date").parquet(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprints of an earlier report: {"findings": [...]}, a list of objects or a list of strings."""
    text = spark.read.option("wholetext", True).text(path)
    objects = F.coalesce(F.from_json(F.get_json_object("value", "$.findings"), "array<struct<fingerprint:string>>"), F.from_json("value", "array<struct<fingerprint:string>>"))
    from_objects = text.select(F.explode_outer(objects).alias("f")).select("f.fingerprint")
    from_strings = text.select(F.explode_outer(F.from_json("value", "array<string>")).alias("fingerprint")).where(F.col("fingerprint").rlike("^[0-9a-f]{32}$"))
    return from_objects.unionByName(from_strings).where("fingerprint is not null").distinct()


def scan_stats(leaves: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of counters over the leaves of a scan: files, blobs, bytes, errors, findings.

    ``leaves`` as of sources.files.unpacked; partial sums are merged by Spark."""
    seen = leaves.agg(F.countDistinct("source_path").alias("files"), F.count_if(F.col("content").isNotNull()).alias("blobs"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"),
                      F.count_if(F.col("message") != "").alias("errors"))
    return seen.withColumn("_k", F.lit(1)).join(findings.agg(F.count(F.lit(1)).alias("findings"), F.lit(1).alias("_k")), "_k").drop("_k")  # two single rows
