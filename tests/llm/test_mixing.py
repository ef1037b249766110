import random

import pytest

from castellan.llm import mixing

TARGETS = "source string, target_share double, max_repeats int"


def test_pivotal_keeps_sums_and_expectations():
    items = [(i, random.Random(i).randrange(1, 50), 0.3) for i in range(200)]
    total = sum(s * p for _, s, p in items)
    hits = [0] * len(items)
    for seed in range(400):
        out, left = mixing.pivotal(items, str(seed))
        assert set(out.values()) <= {0, 1} and len(out) + (left is not None) == len(items)
        assert sum(items[i][1] * v for i, v in out.items()) + (left[1] * left[2] if left else 0) == pytest.approx(total)
        for i, v in out.items():
            hits[i] += v
        if left:
            hits[left[0]] += left[2]
    assert sum(hits) / len(hits) / 400 == pytest.approx(0.3, abs=0.01)
    assert max(abs(h / 400 - 0.3) for h in hits) < 0.12


def test_plan_is_the_largest_mix():
    got = mixing.plan({"a": 100, "b": 50}, [("a", 0.5, 1), ("b", 0.5, 4)])
    assert got == {"a": 1.0, "b": 2.0}
    assert mixing.plan({"a": 100}, [("a", 0.5, 1), ("b", 0.5, 4)])["a"] == 0.0
    assert mixing.plan({}, []) == {}


def test_mix_meets_the_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 40)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rng = random.Random(5)
    rows = [(i, rng.choice(["Big "] * 12 + [" small", "MID", "mid", "other", None]), " ".join(["word"] * rng.randrange(0, 60))) for i in range(1500)] + [(9, "big", None), (9, "big", "a b c"), (None, "mid", "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as p", "2 as base", "3 as n_tokens")
    targets = spark.createDataFrame([("big", 0.5, 1), ("Mid", 0.3, 2), ("small", 0.2, 9), (None, 0.1, 1), ("zero", 0.0, 1)], TARGETS)
    mixed = mixing.mix(docs.drop("n_tokens"), targets)
    assert {r.source for r in mixed.select("source").distinct().collect()} == {"big", "mid", "small"}
    report = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    tokens = sum(r.tokens for r in report.values())
    for source, share, cap in (("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 9)):
        r = report[source]
        assert r.most_copies <= cap and abs(r.tokens - share * tokens) <= 130  # about two documents
        assert r.actual_share == pytest.approx(r.tokens / tokens)
    # as large as possible: one source is used up to its cap, but for the rounding
    full = {s: sum(len((t or "").split()) for _, x, t in rows if (x or "").strip().lower() == s) for s in report}
    assert any(report[s].tokens >= full[s] * {"big": 1, "mid": 2, "small": 9}[s] - 130 for s in full)
    again = mixing.mix(docs.drop("n_tokens").repartition(7), targets)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, mixed.collect()), key=str)


def test_mix_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    assert mixing.mix(docs, targets).count() == 0
    assert mixing.shares(mixing.mix(docs, targets), targets).first().tokens == 0
    some = spark.createDataFrame([(1, "a", "x y z")], "doc_id long, source string, text string")
    assert mixing.mix(some, targets.limit(0)).count() == 0
    assert mixing.mix(some, targets).first().copies == 2


def test_equal_rows_share_no_bucket(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 25)
    largest = []
    monkeypatch.setattr(mixing, "cut", lambda df, real=mixing.cut: largest.append(df) or real(df))
    docs = spark.createDataFrame([(None, "a", "x y z")] * 600 + [(i, "a", "x y") for i in range(200)] + [(i, "b", "u v w") for i in range(500)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.35, 1), ("b", 0.65, 1)], TARGETS)
    mixed = mixing.mix(docs, targets)
    share = {r.source: r.actual_share for r in mixing.shares(mixed, targets).collect()}
    assert share["a"] == pytest.approx(0.35, abs=0.01)
    first = largest[1]  # rows of the first level, with their buckets
    assert first.where("source = 'a'").groupBy("bucket").count().agg({"count": "max"}).first()[0] < 100


def test_checks_see_what_is_wrong(spark):
    targets = spark.createDataFrame([("A", 0.5, 2), ("b", 0.5, 1)], TARGETS)
    sized = spark.createDataFrame([("a", 10)] * 30 + [(" B", 10)] * 60, "source string, n_tokens long")
    mix = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, source string, n_tokens long, copies int")
    verdict = lambda m: {r.source: (r.within_cap, r.share_met, r.as_large_as_possible) for r in mixing.checks(m, targets, sized).collect()}
    good = [(i, "a", 10, 2) for i in range(30)] + [(i, "b", 10, 1) for i in range(60)]
    assert set(verdict(mix(*good)).values()) == {(True, True, True)}
    assert verdict(mix(*good[1:], (0, "a", 10, 3)))["a"][0] is False
    assert verdict(mix(*good[10:]))["a"][1] is False
    assert {v[2] for v in verdict(mix(*good[:10], *good[30:50])).values()} == {False}
