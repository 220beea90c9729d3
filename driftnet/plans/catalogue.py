"""All queries of the engine with their SQL, by name."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet.functions import decode, entropy, parse, scope, validate
from driftnet.functions import text as tx
from driftnet.operators import findings as found
from driftnet.operators import report, state, verify
from driftnet.operators.scan import ScanOptions, rule_matches, scan, token_matches
from driftnet.plans import rules
from driftnet.sources import files, versions, web
from driftnet.storage import fresh_path, spread
from driftnet.streaming import scan as stream


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths a run takes up: new or changed against what the successful runs recorded.

    The run reads the difference of two manifests and commits its paths with the version it
    has processed; what the query returns is that commit."""
    at = fresh_path(spark, "files")
    states = versions.recorded_files(table(spark, sf_dir, "files"), table(spark, sf_dir, "scan_runs"), f"{at}/states")
    versions.list_files(states, table(spark, sf_dir, "file_listing"))
    taken = versions.VersionedTable(spark, f"{at}/taken", "path string")
    versions.take_up(states, taken, lambda d: d.select("path"))
    return taken.read()


def p4_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record deltas between the two versions, with outdated records as deletes."""
    at = fresh_path(spark, "files")
    return versions.file_deltas(table(spark, sf_dir, "files"), table(spark, sf_dir, "scan_runs"), table(spark, sf_dir, "file_listing"), at).withColumnRenamed("_change", "change")


_STATES = """
  with f as (select path, arg_max({'m': mtime, 's': size, 'h': blob_hash}, scanned_at) as r from files
             where path is not null and run_id in (select run_id from scan_runs where state = 'ok') group by 1),
  l as (select path, arg_max({'m': mtime, 's': size, 'h': blob_hash}, listed_at) as r from file_listing where path is not null group by 1),
  b as (select coalesce(f.path, l.path) as path, f.r as o, l.r as n, case when f.r is null or l.r is null then true
               when f.r.h is null or l.r.h is null then f.r.m is distinct from l.r.m or f.r.s is distinct from l.r.s else f.r.h <> l.r.h end as changed
        from f full join l on f.path = l.path)"""


# --- the scan --------------------------------------------------------------------------

def document_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    name = F.concat_ws("/", F.coalesce("repo", F.lit("documents")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return spread(docs.select("doc_id", name.alias("logical_path"), "text"))


def stored_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "blob_texts").select("blob_id", "logical_path", "source_path", "text", "is_binary", "media_type", "line_offset", "commit_line"))


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding in the documents, endpoints and addresses included."""
    return scan(document_blobs(spark, sf_dir), ScanOptions(min_severity="info"))


def scan_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(stored_blobs(spark, sf_dir))


def scan_blobs_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(stored_blobs(spark, sf_dir), ScanOptions(redact=True, decoders=False))


def scan_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule pass over texts cut into 4 KB pieces: the same findings as over whole texts."""
    cut = files.pieces(stored_blobs(spark, sf_dir), files.Limits(piece_bytes=4096, overlap_lines=8))
    return scan(cut, ScanOptions(entropy=False, keynames=False, decoders=False)).select("logical_path", "rule_id", "line", "secret")


def scan_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule pass with all rules, endpoints and addresses included: where each value stands first and what it is paired with."""
    found = scan(stored_blobs(spark, sf_dir), ScanOptions(entropy=False, keynames=False, decoders=False, min_confidence=0.0, min_severity="info"))
    return found.select("logical_path", "rule_id", "line", "column_no", "secret", "secret_v2")


def scan_document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the documents."""
    found = scan(document_blobs(spark, sf_dir), ScanOptions(entropy=False, keynames=False, decoders=False, min_confidence=0.0, min_severity="info"))
    return found.select("logical_path", "rule_id", "line", "column_no", "secret", "secret_v2")


def scan_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entropy pass: long random tokens by their first place."""
    found = scan(stored_blobs(spark, sf_dir), ScanOptions(regex=False, keynames=False, decoders=False, min_confidence=0.0, min_severity="info"))
    return found.select("logical_path", "rule_id", "line", "column_no", "secret")


def scan_document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the documents."""
    found = scan(document_blobs(spark, sf_dir), ScanOptions(regex=False, keynames=False, decoders=False, min_confidence=0.0, min_severity="info"))
    return found.select("logical_path", "rule_id", "line", "column_no", "secret")


def redacted_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as a report shows them: rows, contexts, and contexts that still show a known value of their path."""
    rows = _findings(spark, sf_dir).select("fingerprint", "logical_path", "secret", "match_context")
    # Values of eight characters and more that are not masked in the table.
    known = F.expr(r"case when length(secret) >= 8 and not secret rlike '[*]{2}|[.]{3}|…' then secret end")
    return report.shown_values(report.redacted(rows.withColumn("known", known)))


_FORMATS = ("aws.access-key-id", "gcp.api-key", "gitlab.token", "slack.token", "stripe.secret-key", "npm.token", "sendgrid.api-key", "crypto.private-key", "generic.internal-url", "generic.database-uri", "generic.basic-auth-url")


def _matches(frame: DataFrame, rule_ids: tuple[str, ...], *keep: str) -> DataFrame:
    chosen = [r for r in rules.BUILT_IN if r.rule_id in rule_ids]
    ids = F.array(*(F.lit(r.rule_id) for r in chosen))
    rows = frame.where("text is not null").withColumn("lowered", F.lower("text")).withColumn("h", F.explode(rule_matches(chosen)))
    return rows.select(*keep, "text", F.get(ids, F.col("h.rule_ord")).alias("rule_id"), F.col("h.start").alias("start"), F.col("h.secret").alias("secret"))


def format_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw matches of token formats, before any check."""
    return _matches(stored_blobs(spark, sf_dir), _FORMATS, "blob_id").select("blob_id", "rule_id", "secret").distinct()


def match_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line, column and nearby key of internal endpoints."""
    rows = _matches(stored_blobs(spark, sf_dir), ("generic.internal-url",), "blob_id")
    return rows.select("blob_id", "secret", tx.line_no(F.col("text"), F.col("start")).alias("line"), tx.column_no(F.col("text"), F.col("start")).alias("column_no")).distinct()


def ipv4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.explode(F.regexp_extract_all("text", F.lit(r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"), F.lit(0))).alias("ip")
    seen = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", ip)
    kind = F.when(validate.private_ipv4(F.col("ip")), "private").when(validate.public_ipv4(F.col("ip")), "public").when(validate.valid_ipv4(F.col("ip")), "special").otherwise("invalid")
    return seen.groupBy("ip", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def login_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _matches(stored_blobs(spark, sf_dir), ("generic.database-uri", "generic.basic-auth-url"), "blob_id")
    return rows.select("blob_id", "rule_id", "secret", validate.uri_login(F.col("secret")).alias("real")).distinct()


def assignment_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values assigned to secret-named keys, with the checks of the generic rule."""
    s = F.col("secret")
    rows = _matches(stored_blobs(spark, sf_dir), ("generic.api-key-assignment",), "blob_id").select("blob_id", "secret").distinct()
    return rows.select("blob_id", "secret", F.round(entropy.shannon(s), 3).alias("entropy"), validate.not_placeholder(s).alias("real"), s.rlike("^[a-zA-Z_.-]+$").alias("name_only"), validate.benign_value(s).alias("benign"))


def long_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every long token of the blobs with its entropy and the shape that explains it."""
    rows = stored_blobs(spark, sf_dir).where("text is not null").select("blob_id", "text", F.explode(token_matches()).alias("t")).select("blob_id", F.col("t.secret").alias("token")).distinct()
    t = F.col("token")
    return rows.select("blob_id", "token", entropy.charset(t).alias("charset"), F.round(entropy.shannon(t), 3).alias("entropy"), F.size(F.array_distinct(F.split(t, ""))).alias("n_chars"))


def secret_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("secret")
    rows = table(spark, sf_dir, "findings").where("secret is not null").select("secret").distinct()
    return rows.select("secret", F.round(entropy.shannon(s), 3).alias("entropy"), entropy.charset(s).alias("charset"), validate.benign_value(s).alias("benign"), validate.prose(s).alias("prose"), validate.plain_identifier(s).alias("identifier"))


def structural_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "findings").where("secret is not null").select("secret").distinct()
    return rows.select("secret", entropy.structural_noise(F.col("secret")).alias("noise"), entropy.looks_like_words(F.col("secret")).alias("words"))


def sensitive_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "findings").where("key_name is not null").groupBy("key_name").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("sensitive", validate.sensitive_key(F.col("key_name")))


def _pairs(spark: SparkSession, sf_dir: str, parser, media: str) -> DataFrame:  # noqa: ANN001
    rows = table(spark, sf_dir, "blob_texts").where(F.col("text").isNotNull() & F.lower("media_type").startswith(media))
    return rows.select("blob_id", F.explode(parser(F.col("text"))).alias("p")).select("blob_id", "p.key_path", "p.value").distinct()


def env_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, parse.env_pairs, "text/plain")


def shell_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, parse.shell_pairs, "text/x-shellscript")


def hcl_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, parse.hcl_pairs, "text/x-terraform")


def configuration_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of every blob by its file name, with lines."""
    rows = stored_blobs(spark, sf_dir).where("text is not null and not is_binary")
    pairs = parse.with_lines(parse.pairs_of(F.col("text"), F.col("logical_path")), F.col("text"))
    return rows.select("blob_id", F.explode(pairs).alias("p")).select("blob_id", "p.key_path", "p.value", "p.line").distinct()


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = parse.pairs_of(F.col("props"), F.lit("event.json"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(pairs).alias("p")).select("event_id", "p.key_path", "p.value")


def path_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "files").where("path is not null").select("path").distinct()
    # Through a generator, so that the categories are found once for both of their uses.
    rows, kinds = rows.select("path", F.explode(F.array(scope.categories(F.col("path")))).alias("kinds")), F.col("kinds")
    return rows.select("path", scope.extension(F.col("path")).alias("extension"), F.array_join(kinds, ",").alias("categories"), scope.boost(kinds).alias("boost"), scope.allowed(F.col("path")).alias("allowed"),
                       scope.denied_folder(F.col("path")).alias("denied"))


def context_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "findings").select("logical_path", "match_context").where("logical_path is not null").distinct()
    return rows.select("logical_path", "match_context", F.round(scope.context_penalty(F.col("logical_path"), F.col("match_context")), 3).alias("penalty"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("logical_path")
    return table(spark, sf_dir, "blob_texts").where("logical_path is not null").select("logical_path").distinct().select(
        "logical_path", scope.logical_root(p).alias("root"), scope.base_name(p).alias("base_name"), scope.safe_name(p).alias("safe_name"), F.size(F.split(p, "!/")).alias("depth"))


# --- findings ---------------------------------------------------------------------------

def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "findings")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir).where("rule_id is not null and logical_path is not null and secret is not null")
    made = tx.fingerprint(F.col("rule_id"), F.col("logical_path"), F.col("secret"), F.col("secret_v2"))
    return f.select("rule_id", "logical_path", made.alias("made"), tx.redact(F.col("secret")).alias("redacted")).distinct()


def action_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir)
    return f.groupBy(tx.actionability(F.col("verified"), F.lit(False), F.col("confidence")).alias("tier"), "severity").agg(F.count(F.lit(1)).alias("n"))


def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found.by_severity(_findings(spark, sf_dir))


def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(_findings(spark, sf_dir))


def severity_rule_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found.rollup(_findings(spark, sf_dir), "severity", "rule_id")


def once_per_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found.once(_findings(spark, sf_dir).select("fingerprint", "rule_id", "logical_path", "line", "column_no"))


def findings_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the arrays of a grouping by path hold: how many findings, and the sum of their digests."""
    parts = found.by_path(_findings(spark, sf_dir), 500)
    one = F.concat_ws("|", "f.rule_id", F.col("f.line").cast("string"), "f.fingerprint")
    rows = parts.select("logical_path", F.explode("findings").alias("f")).select("logical_path", F.conv(F.substring(F.md5(one.cast("binary")), 1, 8), 16, 10).cast("bigint").alias("d"))
    return rows.groupBy("logical_path").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("digest"))


def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiered = _findings(spark, sf_dir).where("fingerprint is not null").withColumn("actionability", tx.actionability(F.col("verified"), F.lit(False), F.col("confidence")))
    return found.top(tiered.select("actionability", "severity", "confidence", "logical_path", "line", "fingerprint").distinct(), 100)


def ranked_in_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir).where("logical_path is not null").select("logical_path", "severity", "confidence", "line", "fingerprint").distinct()
    return found.ranked_in_blob(f).select("logical_path", "fingerprint", "line", "place").where("place <= 3")


def capped_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir).where("source_path is not null").select("source_path", "line", "fingerprint").distinct()
    return found.capped(f, 2000, "source_path").groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))


def without_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    baseline = table(spark, sf_dir, "finding_batches").select("fingerprint")
    return found.without_baseline(_findings(spark, sf_dir).select("fingerprint", "rule_id", "logical_path", "line"), baseline)


def nearest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir).select(F.concat_ws(":", "fingerprint", "line").alias("id"), "source_path", "line", "rule_id").distinct()
    return found.nearest_pairs(f.where("rule_id = 'aws.access-key-id'"), f.where("rule_id = 'keyname.password'"))


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the batches' places against the history's places, one line of slack."""
    hits = table(spark, sf_dir, "finding_batches").select(F.col("source_path").alias("path"), "line")
    return found.scores(hits, _findings(spark, sf_dir).select(F.col("source_path").alias("path"), "line"))


def content_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found.copies_scanned_once(table(spark, sf_dir, "blob_texts"))


def sarif_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif_results(_findings(spark, sf_dir)).distinct()


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.json_rows(_findings(spark, sf_dir).select("fingerprint", "rule_id", "severity", "logical_path", "line", "secret", "match_context", "confidence"))


# --- state ------------------------------------------------------------------------------

def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.listing_state(table(spark, sf_dir, "file_listing")).select("path", "blob_hash")


def unchanged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.split_unchanged(_listing(spark, sf_dir), table(spark, sf_dir, "files")).select("path", "unchanged")


def carried_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir).select("fingerprint", "rule_id", "source_path", "line")
    return state.carried(f, state.split_unchanged(_listing(spark, sf_dir), table(spark, sf_dir, "files"))).distinct()


def finding_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "finding_batches").select("fingerprint", F.col("observed_at").alias("seen_at"))
    return state.updated_history(_findings(spark, sf_dir), seen)


def new_and_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.new_and_known(_findings(spark, sf_dir), table(spark, sf_dir, "finding_batches"))


def cached_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals with the verdicts that the history holds for their secrets."""
    f = _findings(spark, sf_dir).where("verified <> 'unknown' and secret is not null")
    cache = f.select(state.secret_key().alias("secret_hash"), F.col("verified").alias("verdict"), F.lit("history").alias("note"), F.col("last_seen").alias("checked_at"))
    arrivals = table(spark, sf_dir, "finding_batches").where("secret is not null").select("arrival_id", "secret")
    return state.with_cached_verdicts(arrivals, cache).select("arrival_id", "secret_hash", "verified").distinct()


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.eligible(_findings(spark, sf_dir)).groupBy("provider").agg(F.count(F.lit(1)).alias("n"))


def revocation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.revocation_plan(_findings(spark, sf_dir))


def rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir).where("secret is not null").select("fingerprint", "detector", "secret", "confidence").distinct()
    return verify.rescored(f, lambda s: F.size(F.regexp_extract_all(s, F.lit("[A-Za-z]{1,4}|[0-9]{1,3}|[^A-Za-z0-9]"), F.lit(0)))).select("fingerprint", F.round("confidence", 3).alias("confidence"))


# --- views, sources, streams --------------------------------------------------------------

def decoded_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of every decoded view of every blob that has one."""
    rows = table(spark, sf_dir, "blob_texts").where("text is not null").select("blob_id", F.explode(decode.views(F.col("text"))).alias("v"))
    return rows.select("blob_id", "v.label", F.length("v.text").alias("n_chars")).distinct()


def escape_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "blob_texts").withColumn("view", decode.escape_view(F.col("text"))).where("view is not null")
    return rows.select("blob_id", F.md5(F.col("view").cast("binary")).alias("digest")).distinct()


def percent_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent views of the findings' contexts."""
    rows = table(spark, sf_dir, "findings").select(F.col("match_context").alias("context")).distinct().withColumn("view", decode.percent_view(F.col("context"))).where("view is not null")
    return rows.select("context", "view")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.event_windows(table(spark, sf_dir, "events")).select("window_start", "event_type", "n", F.round("total", 2).alias("total"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.user_sessions(table(spark, sf_dir, "events"))


def streamed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule pass over the blobs as a stream, micro-batch by micro-batch."""
    at = f"{sf_dir}/blob_texts.parquet"
    schema = spark.read.parquet(at).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(at if spark.read.format("binaryFile").load(at).select("path").limit(2).count() > 1 else f"{sf_dir}/blob_texts.parque*")
    out = fresh_path(spark, "streamed")
    query = stream.scan_stream(source.select(*stored_blobs(spark, sf_dir).columns), out, fresh_path(spark, "progress"), ScanOptions(entropy=False, keynames=False, decoders=False))
    query.awaitTermination()
    return spark.read.parquet(out).select("fingerprint", "rule_id", "logical_path", "line").dropDuplicates(["fingerprint"])


def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rules_frame(spark).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def _fixture(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fixture(spark, [("60/minute",), ("1/second",), ("100/hour",), ("2/s",), ("soon",), ("0/minute",), ("24/day",)], "rate string")
    return rows.select("rate", web.seconds_per_request(F.col("rate")).alias("seconds"))


def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = '<a href="/a/">x</a><a href="b.html#t">y</a><script src="js/app.js"></script><link rel="x" href="https://cdn.example.net/s.css"><a href="mailto:x@y">m</a><iframe src="//f.example.org/i"></iframe>'
    return web.references(_fixture(spark, [("https://www.example.com/docs/index.html", html), (None, html), ("https://www.example.com/", None)], "url string, html string"))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fixture(spark, [("https://h.example.com/a/b.js?x=1",), ("https://h.example.com:8080",), ("http://u@h.example.com/d/",), ("https://h.example.com/#top",)], "url string")
    return rows.select("url", web.logical_path(F.col("url")).alias("logical_path"))


def unpacked_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of a zip in a zip, a gzip and a plain file."""
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as box:
        box.writestr("../deep/.env", "KEY=value\n")
    with zipfile.ZipFile(outer, "w") as box:
        box.writestr("in.zip", inner.getvalue())
        box.writestr("a.txt", "plain text\n")
    rows = [("x.zip", bytearray(outer.getvalue())), ("n.log.gz", bytearray(gzip.compress(b"log line\n", mtime=0))), ("p.txt", bytearray("déjà vu, noted in plain words\n".encode("latin-1")))]
    leaves = files.unpacked(_fixture(spark, rows, "path string, content binary"))
    return files.texts(leaves).select("logical_path", "source_path", "text", "is_binary", "container_depth")


def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of made-up tokens whose right answer is known by construction."""
    import zlib

    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    n, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, tail = n // 62, validate.BASE62[n % 62] + tail
    rows = _fixture(spark, [("right", "ghp" + "_" + body + tail), ("wrong", "ghp" + "_" + body + "000000"), ("other", "token")], "name string, token string")
    return rows.select("name", F.coalesce(validate.github_checksum(F.col("token")).cast("string"), F.lit("none")).alias("valid"), validate.luhn(F.lit("4539 1488 0343 6467")).alias("luhn"))


def _core() -> tuple[Callable[[SparkSession, str], DataFrame], ...]:
    return (scan_documents, scan_blobs, scan_blobs_redacted, scan_rules, scan_document_rules, scan_tokens, scan_document_tokens, redacted_contexts, scan_in_pieces, format_matches, match_places, ipv4_classes, login_uris, assignment_matches, long_tokens, secret_shapes, structural_noise,
            sensitive_keys, env_pairs, shell_pairs, hcl_pairs, configuration_pairs, event_properties, path_scope, context_penalties, path_parts, fingerprints, action_tiers, severity_counts, findings_summary,
            severity_rule_rollup, once_per_fingerprint, findings_by_path, top_findings, ranked_in_blob, capped_per_source, without_baseline, nearest_pairs, evaluation, content_copies, sarif_rows, json_report,
            unchanged_files, carried_findings, finding_history, new_and_known, cached_verdicts, providers, revocation_plan, rescored, decoded_views, escape_views, percent_views, event_windows, event_sessions,
            streamed_scan, rule_table, rate_limits, page_references, page_paths, unpacked_archive, checksums, p4_found, p4_deltas)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _core()}


def oracle_sql() -> dict[str, str]:
    from driftnet.plans.oracles import SQL

    from driftnet.plans import scan_oracle

    return dict(SQL) | {
        "scan_rules": scan_oracle.rule_scan_sql(), "scan_document_rules": scan_oracle.rule_scan_sql(scan_oracle.DOCUMENTS),
        "scan_tokens": scan_oracle.token_scan_sql(), "scan_document_tokens": scan_oracle.token_scan_sql(scan_oracle.DOCUMENTS),
        "path_scope": scan_oracle.path_scope_sql(),
        "p4_found": _STATES + " select path from b where changed and n is not null",
        "p4_deltas": _STATES + """
          select path, n.m as mtime, n.s as size, n.h as blob_hash, 'insert' as change from b where changed and n is not null
          union all select path, o.m, o.s, o.h, 'delete' from b where changed and o is not null""",
    }
