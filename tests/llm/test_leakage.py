"""Leaked passages: brute force, the multi-index guarantee, edges."""

import random

import numpy as np
import pytest

from driftnet.llm import leakage

R = random.Random(2)
WORDS = [f"wört{i}" for i in range(400)]


def shared(a, b, n=13):
    runs = {tuple(a[i:i + n]) for i in range(len(a) - n + 1)}
    return any(tuple(b[i:i + n]) in runs for i in range(len(b) - n + 1))


def test_brute_force(spark):
    items = [(i, " ".join(R.choices(WORDS, k=R.choice([5, 12, 13, 40])))) for i in range(20)]
    docs = []
    for d in range(120):
        words = R.choices(WORDS, k=R.choice([0, 5, 60, 300]))
        if R.random() < 0.6:
            source = R.choice(items)[1].split()
            a = R.randrange(len(source))
            cut = source[a:a + R.choice([11, 12, 13, 20, 40])]
            at = R.randrange(len(words) + 1)
            words[at:at] = [w.upper() for w in cut]
        docs.append((d, R.choice([" ", ", ", "\n— "]).join(words), "x"))
    frame = spark.createDataFrame([*docs, docs[0], (None, "x", "x"), (999, None, "x")], "doc_id long, text string, item_id string").repartition(5)
    bench = spark.createDataFrame([*items, items[0], (None, "x"), (77, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(frame, bench).where("longest_run >= 13").collect()}
    want = {(d, i) for d, t, _ in docs for i, u in items if shared(leakage.words_of(u), leakage.words_of(t))}
    assert got == want and want


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    text = " ".join(WORDS[:100])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(WORDS[i:i + 20])) for i in range(30)], "item_id long, text string")
    whole = sorted(map(tuple, leakage.leaks(docs, items).collect()))
    monkeypatch.setattr(leakage, "BLOCK_WINDOWS", 20)
    assert sorted(map(tuple, leakage.leaks(docs, items).collect())) == whole and len(whole) == 30


@pytest.mark.parametrize("radius", [0, 3, 5])
def test_multi_index_finds_all_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    probes = np.concatenate([base[:100] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (100, k), dtype=np.uint64), axis=1) for k in (1, 3, 5, 8)])
    a, b = leakage.Index(base, radius).near(probes)
    want = {(i, j) for i, p in enumerate(probes) for j, q in enumerate(base) if int(p ^ q).bit_count() <= radius}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_blocks_that_many_share_are_cut(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**16, 400, dtype=np.uint64) << np.uint64(40)  # one key in three of four blocks
    whole = leakage.Index(base, 3).near(base)
    for size in (1, 7, 1000):
        monkeypatch.setattr(leakage, "_MEETINGS", size)
        assert all((a == b).all() for a, b in zip(leakage.Index(base, 3).near(base), whole, strict=True))


def test_near_passages(spark):
    words = WORDS[:60]
    other = list(words)
    item = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    doc = spark.createDataFrame([(1, " ".join(other)), (2, "nothing of it")], "doc_id long, text string")
    row = leakage.leaks(doc, item).first()
    assert (row["longest_run"], row["similarity"]) == (60, 1.0)
    assert leakage.weighted_similarity(words, words) == 1.0 and leakage.weighted_similarity(words, WORDS[100:160]) == 0.0


def test_fingerprints_of_long_texts_are_chunked(monkeypatch):
    hashes = np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64)
    whole = leakage.fingerprints(hashes, 13)
    monkeypatch.setattr(leakage, "_CHUNK", 37)
    assert (leakage.fingerprints(hashes, 13) == whole).all()
    bits = np.unpackbits(hashes[:13].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
    assert (np.unpackbits(whole[:1].view(np.uint8)) == (bits * 2 > 13)).all()


def test_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leakage.leaks(docs, items).count() == 0
