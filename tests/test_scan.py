"""The scan: rules, decoded views, pairs, pieces, and invariance."""

import base64
import html
import random
import string

import pytest
from pyspark.sql import functions as F

from driftnet.functions import validate
from driftnet.operators import report
from driftnet.operators.scan import ScanOptions, scan
from driftnet.plans import rules
from driftnet.sources import files

R = random.Random(7)


def made(prefix, n, alphabet=string.ascii_letters + string.digits):
    return prefix + "".join(R.choice(alphabet) for _ in range(n))


UPPER = string.ascii_uppercase + string.digits


def scanned(spark, rows, **options):
    return scan(spark.createDataFrame(rows, "logical_path string, text string"), ScanOptions(**options)).collect()


@pytest.mark.parametrize(("rule", "line"), [
    ("aws.access-key-id", lambda: "k = " + made("AK" + "IA", 16, UPPER)), ("gcp.api-key", lambda: made("AI" + "za", 35)), ("gitlab.token", lambda: made("glpat" + "-", 20)),
    ("slack.token", lambda: made("xoxb" + "-", 24)), ("stripe.secret-key", lambda: made("sk_" + "live_", 24)), ("npm.token", lambda: made("npm" + "_", 36)), ("sendgrid.api-key", lambda: made("SG.", 22) + "." + made("", 43)),
    ("generic.database-uri", lambda: "postgres://app:" + made("", 12) + "@db.example.com/x"), ("generic.authorization-header", lambda: "Authorization: Bearer " + made("", 24)),
    ("crypto.private-key", lambda: "-----BEGIN RSA " + "PRIVATE KEY-----"), ("twilio.api-key", lambda: made("SK", 32, "0123456789abcdef")), ("telegram.bot-token", lambda: "123456789" + ":AA" + made("", 33)),
    ("openai.api-key", lambda: made("sk-" + "proj-", 40)), ("aws.secret-access-key", lambda: "aws_secret_access_key = " + made("", 40))])
def test_rules_fire(spark, rule, line):
    got = scanned(spark, [("src/a.txt", "first\n  " + line() + "\n")], entropy=False, keynames=False)
    assert rule in {r["rule_id"] for r in got}
    assert {r["line"] for r in got} == {2}


def test_what_is_dropped(spark):
    key = made("AK" + "IA", 16, UPPER)
    rows = [("a", f"k = {key}  # pragma: allowlist secret"), ("b", validate.PUBLISHED[0]), ("c", "AK" + "IA" + "EXAMPLE" + "A" * 9), ("d", None), (None, key), ("e", "")]
    assert scanned(spark, rows, entropy=False, keynames=False) == []


def test_decoded_views_and_plain_first(spark):
    token = made("glpat" + "-", 20)
    b64 = base64.b64encode(f"token {token} end".encode()).decode()
    rows = [("only.txt", f"data {b64}"), ("both.txt", f"{token}\ndata {b64}"), ("html.txt", "&#" + "&#".join(f"{ord(c)};" for c in token))]
    got = {(r["logical_path"], r["secret"]): r for r in scanned(spark, rows, entropy=False, keynames=False) if r["rule_id"] == "gitlab.token"}
    assert set(got) == {("only.txt#base64", token), ("both.txt", token), ("html.txt#html-entity", html.unescape(token))}
    assert got[("only.txt#base64", token)]["confidence"] == pytest.approx(0.9) and "recovered after base64 decoding" in got[("only.txt#base64", token)]["notes"]


def test_pairs_are_linked(spark):
    key, secret, other = made("AK" + "IA", 16, UPPER), made("", 40), made("", 40)
    near = f"id = {key}\naws_secret_access_key = {secret}\n" + "\n" * 60 + f"aws_secret_access_key = {other}\n"
    got = {r["secret"]: r["secret_v2"] for r in scanned(spark, [("a.txt", near)], entropy=False, keynames=False) if r["rule_id"].startswith("aws.")}
    assert got[key] == got[secret] == f"{key}:{secret}" and got[other] is None


def test_keynames(spark):
    got = scanned(spark, [("conf/app.json", '{"redis": {"auth_token": "q8Zk1LmX0pVw7RtY", "name": "x"}, "password": "changeme"}')], regex=False, entropy=False)
    assert [(r["key_name"], r["line"], r["severity"]) for r in got] == [("redis.auth_token", 1, "high")]


def test_entropy(spark):
    token = "".join(random.Random(3).sample(string.ascii_letters + string.digits, 44))
    got = scanned(spark, [("a.py", f"secret = '{token}'\nsha256: {token[::-1]}\n")], regex=False, keynames=False)
    assert [(r["secret"], r["line"], r["severity"]) for r in got] == [(token, 1, "medium")]


def test_pieces_find_each_once_at_true_lines(spark):
    lines = [f"line {i} " + "x" * 60 for i in range(400)]
    places = {37: made("glpat" + "-", 20), 63: made("glpat" + "-", 20), 64: made("glpat" + "-", 20), 399: made("glpat" + "-", 20)}
    for i, t in places.items():
        lines[i] = f"t = {t}"
    whole = spark.createDataFrame([("big.log", "\n".join(lines), 0)], "logical_path string, text string, line_offset int")
    cut = files.pieces(whole, files.Limits(piece_bytes=2000, overlap_lines=5))
    assert cut.count() > 5
    got = [(r["line"], r["secret"]) for r in scan(cut, ScanOptions(entropy=False, keynames=False)).collect() if r["rule_id"] == "gitlab.token"]
    assert sorted(got) == [(i + 1, t) for i, t in sorted(places.items())]


def test_partitions_and_repeats_change_nothing(spark, sf):
    blobs = spark.read.parquet(f"{sf}/blob_texts.parquet")
    one = scan(blobs.repartition(1), ScanOptions(decoders=False))
    many = scan(blobs.union(blobs).repartition(13), ScanOptions(decoders=False))
    assert one.count() > 0 and one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_guards_change_nothing(spark, sf):
    from dataclasses import replace

    blobs = spark.read.parquet(f"{sf}/blob_texts.parquet")
    chosen = rules.select_rules(include=["github", "gitlab", "slack", "stripe", "npm", "pki", "db"])
    bare = [replace(r, guards=()) for r in chosen]
    a, b = (scan(blobs, ScanOptions(rules=r, entropy=False, keynames=False, decoders=False)) for r in (chosen, bare))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_clashing_columns_and_cap(spark):
    t1, t2 = made("glpat" + "-", 20), made("glpat" + "-", 20)
    frame = spark.createDataFrame([("a", f"{t1} {t2}", "x", 3, "y")], "logical_path string, text string, secret string, view_ord int, lowered string")
    assert scan(frame, ScanOptions(entropy=False, keynames=False)).count() == 2
    assert scan(frame, ScanOptions(entropy=False, keynames=False, max_per_blob=1)).count() == 1
    assert scan(frame, ScanOptions(redact=True, entropy=False, keynames=False)).where(F.col("secret").contains(t1)).isEmpty()


def test_select_rules():
    assert [r.rule_id for r in rules.select_rules(include=["github"])] == ["github.token"]
    assert "jwt" not in {r.rule_id for r in rules.select_rules(exclude=["jwt"])}


PACK = r"""
[allowlist]
stopwords = ["abc"]
[[rules]]
id = "acme-token"
description = "acme"
regex = '\b(?i)(acme_[a-z0-9]{12})\b'
keywords = ["ACME_"]
entropy = 2
[[rules.allowlists]]
regexes = ["^acme_0"]
[[rules.allowlists]]
condition = "AND"
regexes = ["x"]
[[rules]]
id = "path-only"
path = "x"
"""


def test_packs(spark, tmp_path):
    file = tmp_path / "own.toml"
    file.write_text(PACK)
    pack, told = rules.load_pack(str(file))
    assert told.loaded == ("acme-token",) and told.skipped == (("path-only", "no pattern"),) and told.ignored == (("acme-token", "allowlist with condition AND"),)
    got = scanned(spark, [("a", "x acme_" + "q8zk1lmx0pvw" + " acme_" + "0" + "8zk1lmx0pvw")], rules=tuple(rules.with_pack(rules.BUILT_IN, pack)), entropy=False, keynames=False)
    assert [r["secret"] for r in got if r["rule_id"] == "acme-token"] == ["acme_" + "q8zk1lmx0pvw"]


def test_java_patterns():
    assert rules.java_pattern(r"(?P<a_b>x)(?#note)[[:alnum:][&&]") == r"(x)[\p{Alnum}\[\&&]"


def test_redacted_contexts_show_no_neighbour(spark):
    key, word, secret, plain = made("AK" + "IA", 16, UPPER), made("", 18), made("", 40), made("Zq8!", 14)
    text = f"x: 1\nid: {key} postgres://app:{word}@db.corp.test/main\naws_secret_access_key: {secret}\npassword: {plain}\n"
    got = scanned(spark, [("a/conf.yml", text)], redact=True)
    assert {r["rule_id"] for r in got} >= {"aws.access-key-id", "aws.secret-access-key", "generic.database-uri"}
    for value in (key, word, secret, plain):
        for r in got:
            assert value not in str(r) and value[:12] not in r["match_context"] and value[-12:] not in r["match_context"]


def test_reports_show_no_neighbour(spark):
    key, word = made("AK" + "IA", 16, UPPER), made("", 18)
    line = f"id = {key} ⏎ url = postgres://app:{word}@db.corp.test/main"
    rows = [("f1", "aws.access-key-id", "a", key, line, None), ("f2", "x", "a", "tiny5", "x = tiny5", f"{key}:{word}"), ("f3", "x", None, None, None, None)]
    got = {r["fingerprint"]: r for r in report.redacted(spark.createDataFrame(rows, "fingerprint string, rule_id string, logical_path string, secret string, match_context string, secret_v2 string")).collect()}
    assert key not in str(got) and word not in str(got) and "tiny5" not in str(got)
    assert got["f3"]["match_context"] is None and got["f3"]["secret"] is None and len(got) == 3


def test_findings_keep_columns_of_their_blob(spark):
    token = made("glpat" + "-", 20)
    blobs = spark.createDataFrame([("a.txt", f"x {token}", ("c1", "dev"), 7)], "logical_path string, text string, git struct<commit:string,author:string>, `age days` int")
    row = scan(blobs, ScanOptions(entropy=False, keynames=False, keep=("git", "age days"))).first()
    assert row["git"]["author"] == "dev" and row["age days"] == 7 and row["secret"] == token


def test_automaton_equals_the_guards(spark, monkeypatch):
    from driftnet.functions import keywords
    from driftnet.operators import scan as operator

    guards = tuple(tuple(r.guards) for r in rules.BUILT_IN)
    for text in ("", "nothing here", "sk-ant-api", "xakia sk_live_ ghp_ eyj", "password = token", "-----begin x", "aakiaakia::"):
        assert keywords.guarded(text, guards) == [i for i, g in enumerate(guards) if any(w in text for w in g)]
    assert keywords.guarded("x", ()) == [] and keywords.guarded("x", ((),)) == []
    rows = [(f"{i}.txt", f"a = {made('glpat' + '-', 20)}\nhttp://10.0.0.{i}/x password='{made('', 20)}' 1.2.3.{i}") for i in range(20)]
    with_guards = sorted((r["rule_id"], r["line"], r["secret"]) for r in scanned(spark, rows, min_severity="info", entropy=False, keynames=False))
    monkeypatch.setattr(operator, "AUTOMATON_RULES", 1)
    assert sorted((r["rule_id"], r["line"], r["secret"]) for r in scanned(spark, rows, min_severity="info", entropy=False, keynames=False)) == with_guards and len(with_guards) > 40
