"""Mixing: token counts, rates, caps, shares, repeatability, edges."""

import os

import pytest

from driftnet.llm import mixing

pytestmark = pytest.mark.skipif(not os.path.exists(mixing.VOCABULARY), reason="no vocabulary files")
TARGETS = "source string, target_share double, max_repeats int"


def docs(spark, extra=()):
    rows = [(i, "word " * 20, "Big ") for i in range(400)] + [(1000 + i, "word " * 20, "small") for i in range(20)] + [(2000 + i, "word " * 20, "untargeted") for i in range(5)]
    return spark.createDataFrame([*rows, rows[0], (None, "x", "big"), (3000, None, "big"), (3001, "x", None), *extra], "doc_id long, text string, source string").repartition(3)


def test_token_count(spark):
    rows = spark.createDataFrame([("Hello world",), ("",), (None,), ("<|endoftext|>",)], "t string")
    assert [r[0] for r in rows.select(mixing.token_count(rows["t"])).collect()] == [2, 0, None, 7]


def test_shares_and_caps(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), (" SMALL", 0.4, 3), ("nothing", 0.1, 2), (None, 0.5, 1)], TARGETS)
    report = {r["source"]: r for r in mixing.mix_report(docs(spark), targets).collect()}
    assert set(report) == {"big", "small", "nothing"}
    assert report["small"]["rate"] == 3.0 and report["small"]["drawn_docs"] == 60
    assert report["nothing"]["drawn_tokens"] == 0 and report["nothing"]["rate"] == 0.0
    assert abs(report["big"]["share_of_total"] - 0.5) < 0.06
    assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1.0)
    drawn = mixing.mixed(docs(spark), targets)
    counts = {r["source"]: r["count"] for r in drawn.groupBy("source").count().collect()}
    assert counts == {s: report[s]["drawn_docs"] for s in ("big", "small")}
    assert drawn.groupBy("doc_id").count().agg({"count": "max"}).first()[0] == 3


def test_repeatable_and_seeded(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    a, b = (sorted(r["doc_id"] for r in mixing.mixed(docs(spark).repartition(n), targets, total_tokens=4000).collect()) for n in (1, 7))
    assert a == b and 0 < len(a) < 400
    assert a != sorted(r["doc_id"] for r in mixing.mixed(docs(spark), targets, seed=8, total_tokens=4000).collect())


def test_nothing(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    assert mixing.mixed(docs(spark).limit(0), targets).count() == 0
    assert mixing.mixed(docs(spark), targets.limit(0)).count() == 0
    assert mixing.mix_report(docs(spark).limit(0), targets).first()["actual_share"] == 0.0
