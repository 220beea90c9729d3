"""Duplicates against all history: brute force, hot groups, increments, edges."""

import random
import re
from datetime import datetime

import pytest

from driftnet.llm import history

FINDINGS = "fingerprint string, rule_id string, match_context string, first_seen timestamp, last_seen timestamp, batch int"
BATCHES = "arrival_id long, batch_no int, fingerprint string, rule_id string, match_context string, blob_hash string, observed_at timestamp, content string"
T = datetime(2026, 1, 1)


def tokens(c):
    return frozenset(re.findall(r"[a-z0-9]+", re.sub(r"[^\x00-\x7f]", " ", c).lower())) if c else frozenset()


def brute(findings, blobs, batches):
    old = [(f[1], tokens(f[2])) for f in findings]
    out = {}
    for a in {b[0]: b for b in batches if b[0] is not None}.values():
        key = lambda b: (2**31 - 1 if b[1] is None else b[1], b[0])
        before = [b for b in batches if b[0] is not None and key(b) < key(a)]
        fp = a[2] is not None and (a[2] in {f[0] for f in findings} or a[2] in {b[2] for b in before})
        blob = a[5] is not None and (a[5].lower() in {b[0].lower() for b in blobs if b[0]} or any(b[5] and b[5].lower() == a[5].lower() and key(b)[0] < key(a)[0] for b in before))
        mine = tokens(a[4])
        near = a[3] is not None and bool(mine) and any(r == a[3] and t and len(mine & t) * 10 >= 7 * len(mine | t) for r, t in old + [(b[3], tokens(b[4])) for b in before])
        out[a[0]] = (fp, blob, near)
    return out


def world(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(90)]

    def context():
        base = r.sample(vocabulary, r.choice([1, 2, 3, 10, 30, 50, 70]))
        return r.choice([" ", ", ", " É "]).join(base)

    contexts = [context() for _ in range(12)]

    def varied():
        words = r.choice(contexts).split()
        for _ in range(r.choice([0, 0, 1, 3, 8])):
            words[r.randrange(len(words))] = r.choice(["X" + str(r.random())[2:8], r.choice(vocabulary).upper()])
        return r.choice([" ".join(words), " ".join(words), None, "", "é ñ"])

    findings = [(r.choice([f"f{r.randrange(40)}", None]), r.choice(["a", "b", None]), varied(), T, T, 1) for _ in range(n)]
    blobs = [(r.choice([f"AB{i}", None]),) for i in range(10)]
    batches = [(i, r.choice([1, 2, 3, None]), r.choice([f"f{r.randrange(300)}", None]), r.choice(["a", "b", None]), varied(), r.choice([f"ab{r.randrange(60)}", None]), T, "x") for i in range(n)]
    return findings, blobs, [*batches, batches[0], (None, 1, "f1", "a", "x", None, T, "x")]


def frames(spark, findings, blobs, batches):
    return spark.createDataFrame(batches, BATCHES), spark.createDataFrame(findings, FINDINGS), spark.createDataFrame(blobs, "blob_hash string")


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_brute_force(spark, seed):
    w = world(seed)
    got = {r["arrival_id"]: (r["by_fingerprint"], r["by_blob"], r["by_context"]) for r in history.check(*frames(spark, *w)).collect()}
    want = brute(*w)
    assert set(got) == set(want)
    for k, (fp, blob, near) in want.items():
        assert (any(got[k]), got[k][0], got[k][1]) == (fp or blob or near, fp, blob)


def test_hot_group_of_rotated_secrets(spark):
    around = " ".join(f"word{i}" for i in range(28))
    rows = [(i, 1 + i % 3, None, "a", f"{around} secret{i}x", None, T, "x") for i in range(1500)]
    got = history.check(*frames(spark, [], [("h",)], rows))
    assert got.where("is_new").count() == 1


def test_batches_one_by_one(spark, tmp_path):
    findings, blobs, batches = world(9, 40)
    batches = [b for b in batches if b[0] is not None and b[1] is not None]
    index = history.HistoryIndex(spark, "hist_test", str(tmp_path / "index"), buckets=4)
    all_, f, b = frames(spark, findings, blobs, batches)
    index.add_history(f, b)
    got = {}
    for no in (1, 2, 3):
        got |= {r["arrival_id"]: r["is_new"] for r in index.check_and_add(all_.where(f"batch_no = {no}")).collect()}
    assert got == {k: not any(v) for k, v in brute(findings, blobs, batches).items()}


def test_refreshed(spark):
    d = [datetime(2026, 1, i) for i in range(1, 9)]
    findings = [("a", "r", None, d[0], d[1], 1), (None, "r", None, d[0], d[1], 1)]
    batches = [(1, 1, "a", "r", None, None, d[4], ""), (2, 1, "b", "r", None, None, d[5], ""), (3, 2, "b", "r", None, None, d[3], ""), (4, 2, None, "r", None, None, d[3], "")]
    all_, f, _ = frames(spark, findings, [("h",)], batches)
    assert {r["fingerprint"]: (r["first_seen"], r["last_seen"]) for r in history.refreshed(f, all_).collect()} == {"a": (d[0], d[4]), "b": (d[3], d[5])}


def test_nothing(spark):
    assert history.check(*frames(spark, [], [], [])).count() == 0
