import random

import numpy as np
import pytest

from castellan.llm import bpe, splitting

PARTS = ["First sentence here. ", "A clause, and more; ", "word ", "\n", "\n\n", "日本語の文章です。", "🙂🙂", "x" * 40, "def f(a):\n    return a\n\n", "  \r\n", "12345678901234567890", "don't ", "é" * 9, "​", "́"]


@pytest.fixture(scope="module")
def size():
    e = bpe.encoder()
    import pyarrow as pa

    return lambda t: int(e.encode(pa.array([t]), with_ids=False)[1][-1])


def test_range_max():
    v = np.random.default_rng(0).integers(0, 50, 300)
    t = splitting.RangeMax(v, 64)
    lo = np.random.default_rng(1).integers(0, 230, 500)
    hi = lo + np.random.default_rng(2).integers(0, 64, 500)
    assert t.query(lo, hi).tolist() == [v[a : b + 1].max() for a, b in zip(lo, hi)]


@pytest.mark.parametrize("most, lap", [(16, 0), (16, 4), (40, 8), (5, 9), (3, 0), (100, 30)])
def test_pieces(spark, size, most, lap):
    rng = random.Random(most)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(1, 120))) for _ in range(25)] + [None, "", "short", "y" * 4000, "日" * 800, "\n" * 2000]
    docs = spark.createDataFrame([(i, t, " Chat" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, doc_kind string").selectExpr("*", "0 as piece", "1 as _kind")
    limits = spark.createDataFrame([("chat", most, lap), ("default", most, lap), (None, 1, 0)], "doc_kind string, max_tokens int, overlap_tokens int")
    got = {}
    for r in splitting.pieces(docs, limits).collect():
        got.setdefault(r.doc_id, []).append(r)
    exact = other = 0
    for i, t in enumerate(texts):
        t = t or ""
        if size(t) <= most:
            assert i not in got
            continue
        ps = sorted(got[i], key=lambda r: r.piece_no)
        assert [p.piece_no for p in ps] == list(range(len(ps)))
        assert ps[0].start_char == 0 and ps[-1].end_char == len(t)
        for a, b in zip([None, *ps], ps):
            assert b.piece == t[b.start_char : b.end_char] and b.n_tokens == size(b.piece)
            assert b.n_tokens <= most or len(b.piece) == 1
            if a is not None:
                assert a.start_char < b.start_char <= a.end_char < b.end_char
                assert b.overlap_tokens == size(t[b.start_char : a.end_char])
                exact, other = exact + (b.overlap_tokens == min(lap, most - 1)), other + 1
    if most >= 16:
        assert exact > 0.7 * other


def test_cuts_are_natural(spark):
    text = ("One sentence of a few words. " * 3 + "\n\n") * 20
    docs = spark.createDataFrame([(1, text, None)], "doc_id long, text string, doc_kind string")
    limits = spark.createDataFrame([("default", 40, 0)], "doc_kind string, max_tokens int, overlap_tokens int")
    pieces = [r.piece for r in splitting.pieces(docs, limits).orderBy("piece_no").collect()]
    assert len(pieces) > 10 and all(p.endswith("\n\n") for p in pieces)
    none = splitting.pieces(docs, limits.where("doc_kind is null"))  # no limit for the kind: whole
    assert none.count() == 0 and splitting.pieces(docs.limit(0), limits).count() == 0


def test_a_natural_end_before_half_of_the_limit_is_better_than_none(spark):
    text = "Some words to begin with, and an end.\n" + "q7x" * 400 + "\nAnother line.\n"
    docs = spark.createDataFrame([(1, text, None), (2, "q7x" * 400, None)], "doc_id long, text string, doc_kind string")
    limits = spark.createDataFrame([(" Default", 60, 4)], "doc_kind string, max_tokens int, overlap_tokens int")
    got = splitting.pieces(docs, limits).orderBy("doc_id", "piece_no").collect()
    assert got[0].piece == "Some words to begin with, and an end.\n" and all(r.n_tokens <= 60 for r in got) and {r.doc_id for r in got} == {1, 2}
    for i in (1, 2):
        ps = [r for r in got if r.doc_id == i]
        assert all(a.start_char < b.start_char <= a.end_char < b.end_char for a, b in zip(ps, ps[1:])) and ps[-1].end_char == len((text, "q7x" * 400)[i - 1])


def test_checks_see_what_is_wrong(spark, monkeypatch):
    text = "One sentence of a few words. " * 30
    docs = spark.createDataFrame([(1, text, None), (2, "short", None), (3, None, "chat")], "doc_id long, text string, doc_kind string")
    limits = spark.createDataFrame([("default", 40, 5)], "doc_kind string, max_tokens int, overlap_tokens int")
    sound = lambda: {r.doc_id: r.sound for r in splitting.checks(docs, limits).collect()}
    assert sound() == {1: True, 2: True, 3: True}
    real = splitting.pieces
    for wrong in ("piece_no <> 1", "piece_no <> 0", "piece_no < 3"):  # a piece is missing
        monkeypatch.setattr(splitting, "pieces", lambda *a, w=wrong: real(*a).where(w))
        assert sound() == {1: False, 2: True, 3: True}
    monkeypatch.setattr(splitting, "pieces", lambda *a: real(*a).where("false"))  # not cut at all
    assert sound() == {1: False, 2: True, 3: True}
    monkeypatch.setattr(splitting, "pieces", lambda *a: real(*a).selectExpr("doc_id", "piece_no", "start_char", "end_char", "n_tokens + 1 as n_tokens", "overlap_tokens", "upper(piece) as piece"))
    assert sound()[1] is False
