"""Scalar functions against plain Python and known answers."""

import base64
import html
import math
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftnet.functions import decode, entropy, ingest, parse, scope, text, validate


def column(spark, values, expression, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").repartition(3)
    return [r[1] for r in sorted(frame.select("i", expression(F.col("v")).alias("r")).collect())]


def test_shannon(spark):
    values = ["", "aaaaaaaa", "ab" * 8, "Zk3q9-pÄ日", None]
    want = [None if v is None else -sum(n / len(v) * math.log2(n / len(v)) for n in Counter(v).values()) for v in values]
    got = column(spark, values, entropy.shannon)
    assert [None if x is None else round(x, 9) + 0.0 for x in got] == [None if x is None else round(x, 9) + 0.0 for x in want]


@pytest.mark.parametrize(("token", "noise"), [
    ("123e4567-e89b-12d3-a456-426614174000", True), ("0" * 8 + "a1b2c3d4" * 4, True), ("getUserProfileData", True), ("connectionstring", True), ("2024-01-02-build", True),
    ("one_two_three_four", True), ("aaaabbbbccccdddd", True), ("q8Zk1LmX0pVw7RtY3uJs", False)])
def test_structural_noise(spark, token, noise):
    assert column(spark, [token], entropy.structural_noise) == [noise]


def test_positions(spark):
    body = "a\nbb ü日x\r\n  key = 'v'"
    start = body.index("x")
    row = spark.createDataFrame([(body, start)], "t string, s int").select(
        text.line_no(F.col("t"), F.col("s")), text.column_no(F.col("t"), F.col("s")), text.line_text(F.col("t"), F.col("s")), text.context(F.col("t"), F.col("s"), F.lit(1), 2)).first()
    assert tuple(row) == (2, 6, "bb ü日x\r", "ü日x  ⏎")


def test_redact_and_fingerprint(spark):
    assert column(spark, ["short", "abcdefghijkl", None], text.redact) == ["*****", "abcd...ijkl", None]
    import hashlib

    row = spark.range(1).select(text.fingerprint(F.lit("r"), F.lit("p"), F.lit("s")), text.fingerprint(F.lit("r"), F.lit("p"), F.lit("s"), F.lit("")), text.fingerprint(F.lit("r"), F.lit("p"), F.lit("s"), F.lit("a:b"))).first()
    assert row[0] == hashlib.sha256(b"r\0p\0s").hexdigest()[:32] == row[1] != row[2]


def test_scrub(spark):
    row = spark.range(1).select(text.scrub(F.lit("x=abcdefghijkl y=abcdefgh"), F.array(F.lit("abcdefgh"), F.lit("abcdefghijkl"), F.lit("x")))).first()
    assert row[0] == "x=abcd...ijkl y=********"


@pytest.mark.parametrize(("ip", "kind"), [("10.0.0.1", "private"), ("172.16.0.1", "private"), ("192.168.1.1", "private"), ("8.8.8.8", "public"), ("127.0.0.1", "none"), ("224.0.0.1", "none"), ("169.254.1.1", "none"), ("300.1.1.1", "none"), ("1.2.3", "none")])
def test_addresses(spark, ip, kind):
    assert column(spark, [ip], validate.private_ipv4) == [kind == "private"]
    assert column(spark, [ip], validate.public_ipv4) == [kind == "public"]


def test_checksum_of_tokens(spark):
    body, n, tail = "Q1w2E3r4T5y6U7i8O9p0A1s2D3f4G5", zlib.crc32(b"Q1w2E3r4T5y6U7i8O9p0A1s2D3f4G5"), ""
    for _ in range(6):
        n, tail = n // 62, validate.BASE62[n % 62] + tail
    right = "ghp" + "_" + body + tail
    assert column(spark, [right, right[:-1] + ("0" if right[-1] != "0" else "1"), "no token"], validate.github_checksum) == [True, False, None]


def test_jwt(spark):
    def part(raw):
        return base64.urlsafe_b64encode(raw).decode().rstrip("=")

    good, bad = (".".join((part(h), part(b'{"a":1}'), "s" * 12)) for h in (b'{"alg":"none","x":1}', b'{"typ":"x"}'))
    assert column(spark, [good, bad, "a.b"], validate.valid_jwt) == [True, False, False]


def test_uri_login(spark):
    assert column(spark, ["postgres://u:pw1@db.example.com/x", "postgres://u:changeme@h/x", "postgres://h/x"], validate.uri_login) == [True, False, False]


@pytest.mark.parametrize(("path", "kinds", "allowed", "denied"), [
    ("app/.env.production", ["config"], True, False), ("home/.ssh/id_rsa", ["keys"], True, False), (".git/config", ["config", "vcs"], True, False), ("a/dist.tar.gz", ["archive"], True, False),
    ("notes.md", [], True, False), ("logo.png", [], False, False), ("x/node_modules/y.js", ["frontend"], True, True), ("w/main.js.map", ["sourcemap"], True, False), ("go/pkg/mod/a.go", [], True, False), ("/go/pkg/mod/a.go", [], True, True)])
def test_scope(spark, path, kinds, allowed, denied):
    assert column(spark, [path], scope.categories) == [kinds]
    assert column(spark, [path], scope.allowed) == [allowed]
    assert column(spark, [path], scope.denied_folder) == [denied]


def test_scope_choices(spark):
    paths = ["a.png", "b.pem", "c.md"]
    assert column(spark, paths, lambda c: scope.allowed(c, include=["*.png"], exclude=["b.*"])) == [True, False, True]
    assert column(spark, paths, lambda c: scope.allowed(c, only=["keys"])) == [False, True, False]
    assert column(spark, paths, lambda c: scope.allowed(c, scope_only=True)) == [False, True, False]


def test_penalty(spark):
    assert column(spark, ["src/a.py", "tests/fixtures/a.py", "x/foo_test.go", "attestation/a.py"], lambda c: scope.context_penalty(c, F.lit("# x"))) == [0.1, 0.30000000000000004, 0.30000000000000004, 0.1] or \
        [round(x, 3) for x in column(spark, ["src/a.py", "tests/fixtures/a.py", "x/foo_test.go", "attestation/a.py"], lambda c: scope.context_penalty(c, F.lit("# x")))] == [0.1, 0.3, 0.3, 0.1]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x2FF), max_size=60), min_size=1, max_size=8))
def test_entity_and_percent_views(spark, values):
    encoded = ["".join(f"&#{ord(c)};" if ord(c) % 3 == 0 else html.escape(c) for c in v) for v in values]
    assert column(spark, encoded, decode.entity_view) == [html.unescape(e) if html.unescape(e) != e else None for e in encoded]
    percent = ["".join(f"%{ord(c):02X}" if ord(c) < 256 and ord(c) % 2 else c for c in v) for v in values]
    import re

    want = [re.sub("%[0-9a-fA-F]{2}", lambda m: chr(int(m.group()[1:], 16)), p) for p in percent]
    assert column(spark, percent, decode.percent_view) == [w if w != p else None for w, p in zip(want, percent, strict=True)]


def test_base64_view(spark):
    secret = "password=hunter2-and-more"
    wrapped = "x: " + base64.b64encode(secret.encode()).decode() + " end"
    assert column(spark, [wrapped, "x" * 30 + "-/+_", None], decode.base64_view) == [f"x: {secret} end", None, None]


def test_escape_view(spark):
    assert column(spark, [r"aA\x42c", "plain"], decode.escape_view) == ["aABc", None]


def test_views_of_a_text_over_four_mi_characters(spark):
    secret = "password=hunter2-and-more"
    forms = [base64.b64encode(secret.encode()).decode(), "".join(f"\\x{ord(c):02x}" for c in secret), "".join(f"%{ord(c):02X}" for c in secret), "".join(f"&#{ord(c)};" for c in secret)]
    long = "one line of a log\n" * (1 + (4 << 20) // 18)
    rows = spark.createDataFrame([(f"{forms[0]} {long}{f}",) for f in forms], "c string").select(F.explode(decode.views(F.col("c"))).alias("v"))
    got = rows.select("v.label", F.endswith("v.text", F.lit(secret)).alias("last"), F.startswith("v.text", F.lit(secret)).alias("first")).collect()
    assert sorted(r["label"] for r in got if r["last"]) == ["base64", "html-entity", "percent", "unicode-escape"] and sum(r["first"] for r in got if r["label"] == "base64") == 4


@pytest.mark.parametrize(("name", "body", "pairs"), [
    ("a/.env", "export A='x y'\n# c\nB=1 # note\n", [("A", "x y"), ("B", "1")]), ("a.json", '{"a": {"b": ["s", 2, true]}} // c', [("a.b[0]", "s"), ("a.b[1]", "2")]),
    ("a.tf", 'x = "v"\ny = 3\n', [("x", "v"), ("y", "3")]), ("a.reg", '"K"="v\\\\w"\n"D"=dword:1\n', [("K", "v\\w")]), ("a.service", "Environment=TOKEN=abc\n", [("TOKEN", "abc")]),
    ("a.toml", "[s]\nk = 'v'\n", [("s.k", "v")]), ("a.ini", "[s]\nk = v\n", [("s.k", "v")]), ("a.xml", "<r a='1'><k>v</k></r>", [("r@a", "1"), ("r.k", "v")]), ("Dockerfile", "ENV A=b\nARG C d\n", [("A", "b"), ("C", "d")]),
    (".npmrc", "//h/:_authToken=t\n", [("//h/:_authToken", "t")]), ("a.properties", "k: v\n! c\n", [("k", "v")]), ("x.sh", "A=\"q\"\nB='r'\nC=s;\n", [("A", "q"), ("B", "r"), ("C", "s")]), ("a.json", "{broken", []), ("a.json", "", [])])
def test_pairs(spark, name, body, pairs):
    frame = spark.createDataFrame([(name, body)], "p string, t string")
    got = frame.select(parse.with_lines(parse.pairs_of(F.col("t"), F.col("p")), F.col("t")).alias("x")).first()[0]
    assert [(p["key_path"], p["value"]) for p in got] == pairs
    assert all(p["line"] >= 1 or p["value"] not in body for p in got)


def test_bytes(spark):
    plain, latin = "é and ß in a longer text", "café au lait, s'il vous plait"
    values = [bytearray(v) for v in (b"plain text here", b"\x00\x01\x02\x03abc", plain.encode(), latin.encode("latin-1"), "wide".encode("utf-16"), b"")]
    assert column(spark, values, ingest.looks_binary, "binary") == [False, True, False, False, False, False]
    assert column(spark, values, ingest.text_of, "binary")[2:] == [plain, latin, "wide", ""]
    carved = column(spark, [bytearray(b"\x00\x01secret-value\x00\x00" + "wide-value".encode("utf-16-le"))], ingest.strings_of, "binary")
    assert carved == ["secret-value\nwide-value"]
    assert column(spark, [bytearray(b"PK\x03\x04xx"), bytearray(b"\x1f\x8bxx"), bytearray(b"text")], ingest.archive_kind, "binary") == ["zip", "gzip", None]
