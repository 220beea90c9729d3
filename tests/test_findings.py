"""Findings, state, verdicts and reports against brute force on small tables."""

import json
import random
from datetime import datetime

from pyspark.sql import functions as F

from driftnet.functions import text as tx
from driftnet.operators import findings as found
from driftnet.operators import report, state, verify
from driftnet.plans import catalogue

R = random.Random(5)
T = [datetime(2026, 1, d) for d in range(1, 20)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_nearest_pairs_is_brute_force(spark):
    a = [(f"a{i}", R.choice(["g", "h", None]), R.randrange(400)) for i in range(60)]
    b = [(f"b{i}", R.choice(["g", "h", None]), R.randrange(400)) for i in range(60)]
    schema = "id string, source_path string, line int"
    want = {}
    for i, g, n in a:
        near = sorted((abs(n - m), j) for j, h, m in b if g is not None and g == h and abs(n - m) <= 40)
        if near:
            want[i] = (near[0][1], near[0][0])
    got = {r["id"]: (r["partner"], r["distance"]) for r in found.nearest_pairs(frame(spark, a, schema), frame(spark, b, schema)).collect()}
    assert got == want


def test_scores(spark):
    truth = frame(spark, [("f", 10), ("f", 20), (None, 1)], "path string, line int")
    hits = frame(spark, [("f", 11), ("f", 30), ("f", 11), ("g", 10)], "path string, line int")
    row = found.scores(hits, truth).first()
    assert (row["tp"], row["fp"], row["fn"]) == (1, 2, 1)
    assert found.scores(hits.limit(0), truth.limit(0)).first()["f1"] == 0.0


def test_counts_and_ranks(spark):
    rows = [("f1", "r", "high", "p", 1, 1, 0.9), ("f1", "r", "high", "p", 1, 1, 0.9), ("f2", "s", "low", "p", 2, 1, 0.5), (None, "s", None, None, None, None, None)]
    f = frame(spark, rows, "fingerprint string, rule_id string, severity string, logical_path string, line int, column_no int, confidence double")
    assert {r["severity"]: r["n"] for r in found.by_severity(f).collect()} == {"critical": 0, "high": 2, "medium": 0, "low": 1, "info": 0}
    assert found.once(f).count() == 2
    assert sorted((r["fingerprint"], r["place"]) for r in found.ranked_in_blob(f.where("fingerprint is not null").distinct()).collect()) == [("f1", 1), ("f2", 2)]
    assert found.capped(f.where("logical_path is not null"), 1).count() == 1
    assert found.without_baseline(f, frame(spark, [("f1",), (None,)], "fingerprint string")).count() == 2
    assert sum(r["n"] for r in found.by_path(f.where("logical_path is not null"), 1).collect()) == 3


def test_incremental(spark):
    now = frame(spark, [("a", "1"), ("b", "2"), ("c", None)], "path string, blob_hash string")
    before = frame(spark, [("a", "1"), ("b", "9"), ("c", None), ("a", "1")], "path string, blob_hash string")
    split = state.split_unchanged(now, before)
    assert {r["path"]: r["unchanged"] for r in split.collect()} == {"a": True, "b": False, "c": False}
    stored = frame(spark, [("f", "a"), ("g", "b")], "fingerprint string, source_path string")
    assert [r["fingerprint"] for r in state.carried(stored, split).collect()] == ["f"]
    assert state.complete_report(frame(spark, [("h", "b")], "fingerprint string, source_path string"), stored, split).count() == 2


def test_history(spark):
    old = frame(spark, [("a", T[0], T[1]), ("a", T[2], T[3])], "fingerprint string, first_seen timestamp, last_seen timestamp")
    seen = frame(spark, [("a", T[5]), ("b", T[6]), ("b", T[7]), (None, T[8])], "fingerprint string, seen_at timestamp")
    got = {r["fingerprint"]: (r["first_seen"], r["last_seen"], r["is_new"]) for r in state.updated_history(old, seen).collect()}
    assert got == {"a": (T[0], T[5], False), "b": (T[6], T[7], True)}
    assert tuple(state.new_and_known(old, seen).first()) == (1, 1)


def test_rehydrated_and_upserted(spark):
    keys = "rule_id string, logical_path string, line int, column_no int, secret string, match_context string, key_name string"
    kept = frame(spark, [("r", "p", 1, 1, "ab...", None, None), ("r", "q", 1, 1, "x", "y", "z")], keys)
    new = frame(spark, [("r", "p", 1, 1, "abcdef", "ctx", "k")], keys)
    assert sorted(r["secret"] for r in state.rehydrated(kept, new).collect()) == ["abcdef", "x"]
    assert state.upserted(kept, new.withColumn("logical_path", F.lit("q")), "logical_path").count() == 2


def test_verdicts_are_asked_once(spark):
    f = frame(spark, [("github.token", "s1", 0.9)] * 5 + [("gcp.api-key", "s2", 0.9), ("github.token", "s3", 0.1), ("entropy.hex", "s4", 0.9)], "rule_id string, secret string, confidence double")
    got = {(r["provider"], r["verdict"]) for r in verify.verified(f, lambda p, s: (200 if s == "s1" else 500, "")).collect()}
    assert got == {("github", "active"), ("gcp", "unsupported")}
    plan = verify.revocation_plan(f.withColumn("verified", F.lit("active"))).collect()
    assert {(r["provider"], r["automated"]) for r in plan} == {("github", False), ("gcp", False)}


def test_reports(spark, tmp_path):
    rows = [("f1", "r1", "critical", "a b.py", 0, "abcdefghijklmnop", "x abcdefghijklmnop", 0.9, "candidate"), ("f2", "r2", "info", "c.py", 3, "abc", None, 0.5, "candidate")]
    f = frame(spark, rows, "fingerprint string, rule_id string, severity string, logical_path string, line int, secret string, match_context string, confidence double, actionability string")
    sarif = {r["rule_id"]: r for r in report.sarif_results(f).collect()}
    assert sarif["r1"]["level"] == "error" and sarif["r1"]["line"] == 1 and sarif["r1"]["uri"] == "a%20b.py"
    assert json.loads(sarif["r1"]["result"])["partialFingerprints"]["secretIdentity/v1"] == "f1"
    assert all("abcdefghijklmnop" not in r["document"] for r in report.json_rows(f).collect())
    assert report.exit_code(f, "high") == 1 and report.exit_code(f.where("severity = 'info'"), "high") == 0
    assert "abcdefghijklmnop" not in report.table_text(f) and "r1" in report.table_text(f)
    report.write_sarif(f, str(tmp_path / "sarif"))
    assert sum(len(json.loads(r[0])["runs"][0]["results"]) for r in spark.read.text(str(tmp_path / "sarif")).collect()) == 2
    for n, body in enumerate(('{"findings": [{"fingerprint": "' + "a" * 32 + '"}]}', '[{"fingerprint": "' + "b" * 32 + '"}]', '["' + "c" * 32 + '"]')):
        (tmp_path / f"{n}.json").write_text(body)
        assert [r[0] for r in report.load_baseline(spark, str(tmp_path / f"{n}.json")).collect()] == ["abc"[n] * 32]


def test_rescored(spark):
    f = frame(spark, [("regex", "q8Z!", 0.5), ("regex", "aaaaaaaaaaaa", 0.5), ("keyname", "q8Z!", 0.5), ("regex", "q8Z!", 0.9)], "detector string, secret string, confidence double")
    got = sorted((r["detector"], r["secret"], r["confidence"]) for r in verify.rescored(f, lambda s: F.size(F.array_distinct(F.split(s, "")))).collect())
    assert got == [("keyname", "q8Z!", 0.5), ("regex", "aaaaaaaaaaaa", 0.4), ("regex", "q8Z!", 0.6), ("regex", "q8Z!", 0.9)]


def test_ranks(spark):
    assert [r[0] for r in spark.createDataFrame([("critical",), ("INFO",), ("odd",)], "s string").select(tx.severity_rank(F.col("s"))).collect()] == [4, 0, None]


def test_asking_providers(spark):
    rows = [("github.token", "g1", None, 0.9), ("github.token", "g1", None, 0.8), ("slack.token", "s1", None, 0.9), ("slack.token", "s2", None, 0.9), ("stripe.secret-key", "p1", None, 0.9), ("openai.api-key", "o1", None, 0.9),
            ("aws.access-key-id", "AK" + "ID", "AK" + "ID:key", 0.9), ("aws.access-key-id", "lone", None, 0.9), ("gcp.api-key", "x", None, 0.9), ("github.token", "unsure", None, 0.3), ("other", "y", None, 0.9), ("stripe.secret-key", None, None, 0.9)]
    f = spark.createDataFrame(rows, "rule_id string, secret string, secret_v2 string, confidence double")

    def send(request):
        login = request.headers["Authorization"]
        if "github" in request.url:
            return 200, {"X-OAuth-Scopes": "repo, gist"}, '{"login": "dev"}'
        if "slack" in request.url:
            return 200, {}, '{"ok": true, "user": "u", "team": "t"}' if login.endswith("s1") else '{"ok": false}'
        if "stripe" in request.url:
            raise TimeoutError
        if "openai" in request.url:
            return 500, {}, ""
        assert login.startswith("AWS4-HMAC-SHA256 Credential=AK" + "ID/") and "GetCallerIdentity" in request.body
        return 200, {}, "<Arn>arn:x</Arn><Account>7</Account>"

    got = sorted((r["provider"], r["verdict"], r["note"], r["identity"], r["team"]) for r in verify.asked_about(f, send).collect())
    assert got == [("aws", "active", "aws arn:x", "arn:x", "7"), ("aws", "unsupported", "no pair of id and secret", None, None), ("gcp", "unsupported", "no verifier", None, None),
                   ("github", "active", "github dev scopes: repo, gist", "dev", None), ("openai", "error", "openai http 500", None, None), ("slack", "active", "slack u", "u", "t"),
                   ("slack", "inactive", "slack rejected", None, None), ("stripe", "error", "stripe: TimeoutError", None, None)]
    cache = f.where("secret = 'g1'").select(state.secret_key().alias("secret_hash"))
    assert "github" not in {r["provider"] for r in verify.asked_about(f, send, cache).collect()}
    assert verify.asked_about(f, send, budget=2).count() == 2 and verify.asked_about(f.limit(0), send).count() == 0


def shuffled(node):
    """Bytes put into the exchanges of a plan that ran."""
    kind = node.nodeName()
    inner = node.executedPlan() if kind == "AdaptiveSparkPlan" else node.plan() if kind.endswith("QueryStage") else None
    if inner is not None:
        return shuffled(inner)
    own = node.metrics().apply("dataSize").value() if kind == "Exchange" else 0
    return own + sum(shuffled(node.children().apply(i)) for i in range(node.children().size()))


def word(n, letters="abcdefgh"):
    return "".join(R.choice(letters) for _ in range(n))


def test_shown_values_are_brute_force(spark, tmp_path, monkeypatch):
    # A hot path whose values share their beginnings and contain one another, small ones, null paths, equal rows.
    stem = [word(8), word(9, "é𝄞x")]
    values = [s + word(R.randrange(4), "ab") for s in stem for _ in range(60)] + [word(20) for _ in range(30)] + ["short", "masked**value", "masked...value", "x" * 7, None]
    pick = lambda: R.choice(values)
    rows = [(f"f{i}", R.choice(["hot", "hot", "hot", f"p{i % 20}", None]), pick(), R.choice([None, "", "k", f"k={pick()} ⏎ {pick()}{pick()} z", f"{pick()}"])) for i in range(600)]
    rows += R.sample(rows, 100)
    spark.createDataFrame(rows, "fingerprint string, logical_path string, secret string, match_context string").repartition(3).write.parquet(f"{tmp_path}/findings.parquet")
    known = {(p, v) for _, p, v, _ in rows if p and v and len(v) >= 8 and not any(m in v for m in ("**", "...", "…"))}
    leaks = sum(p == q and v in c for q, c in {(p, c) for _, p, _, c in rows if p and c} for p, v in known)
    assert sum(p == "hot" for p, _ in known) > report.FEW and leaks > 300
    counts = (len(rows), sum(c is not None for *_, c in rows), sum(v is not None for _, _, v, _ in rows))
    monkeypatch.setattr(report, "redacted", lambda f: f)
    assert tuple(catalogue.redacted_contexts(spark, str(tmp_path)).first()) == (*counts, leaks)


def test_redacted_contexts_of_no_findings(spark, tmp_path):
    spark.createDataFrame([], "fingerprint string, logical_path string, secret string, match_context string").write.parquet(f"{tmp_path}/findings.parquet")
    assert tuple(catalogue.redacted_contexts(spark, str(tmp_path)).first()) == (0, 0, 0, 0)


def test_redacted_contexts_shuffle_each_row_once(spark, tmp_path):
    rows = [(f"f{i}", f"p{i // 2}", word(20), " ".join(word(9) for _ in range(30))) for i in range(200)]
    spark.createDataFrame(rows, "fingerprint string, logical_path string, secret string, match_context string").write.parquet(f"{tmp_path}/findings.parquet")
    broadcast = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(broadcast)
    spark.conf.set(broadcast, "-1")  # values of a large table are not broadcast either
    try:
        counted = catalogue.redacted_contexts(spark, str(tmp_path))
        assert [r["n_leaks"] for r in counted.collect()] == [0]
    finally:
        spark.conf.set(broadcast, before)
    size = shuffled(counted._jdf.queryExecution().executedPlan())
    text = sum(len(c) for *_, c in rows)
    assert text // 2 < size < 3 * text
