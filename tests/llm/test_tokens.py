import base64
import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from castellan.llm import bpe, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder()


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def ids_of(enc, texts):
    ids, off = enc.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(off, off[1:])]


PIECES = [" ", "  ", "\n", "\t", "'s", "'re", "'ll", "'", "a", "B", "the", "12", "½", ".", "!?", "é", "日本", " ", "​", "\r\n", "́", "\U0001f600", "<|endoftext|>", "_", "ا", "'S", "　"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PIECES), st.characters(codec="utf-8")), max_size=30).map("".join), max_size=6))
def test_equals_the_tokenizer(enc, reference, texts):
    assert ids_of(enc, texts) == [reference(t) for t in texts]


def test_both_libraries_agree_on_every_letter_class(enc):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    texts = [f"x {chr(c)}1 {chr(c)}" for c in range(0x20, 0x3000) if not 0xD800 <= c < 0xE000]
    assert ids_of(enc, texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("word", ["a" * 3000, "日本" * 1500, "ab" * 400, "A9z" * 300, " " * 2000 + "x", "🙂" * 500])
def test_long_words(enc, reference, word):
    assert ids_of(enc, [word, "x" + word]) == [reference(word), reference("x" + word)]
    data = word.encode()
    assert enc._heap(data).tolist() == enc._rounds([data])[0].tolist()


def test_nulls_slices_and_full_caches(enc, reference, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 20)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 8)
    texts = [None, "", "one two three four five six seven", None, "zwölf Boxkämpfer jagen Viktor", " ", "x"]
    small = bpe.Encoder(bpe.DEFAULT_VOCABULARY)
    want = [reference(t or "") for t in texts]
    assert ids_of(small, texts) == want and ids_of(small, texts) == want
    sliced = pa.array([*texts, "cut off"], pa.string()).slice(2, 5)
    ids, off = small.encode(sliced)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == want[2:]
    assert np.diff(small.encode(sliced, with_ids=False)[1]).tolist() == [len(w) for w in want[2:]]


def test_tables(spark, reference):
    rows = [(1, "hello world"), (2, None), (3, ""), (1, "hello world"), (None, "x" * 5000 + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as ids", "1 as n_tokens0", "2 as _text")
    got = sorted(((r.doc_id or 0, r.ids) for r in tokens.token_ids(df).collect()))
    assert got == sorted((i or 0, reference(t or "")) for i, t in rows)
    counts = tokens.with_token_counts(df.drop("_text"))
    assert sorted(r.n_tokens for r in counts.collect()) == sorted(len(reference(t or "")) for _, t in rows)
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_ids_decode_to_their_texts(spark):
    from castellan.llm import tokens

    texts = ["", None, "plain words\n\n", "日本語 🙂 é̀", "\x00\x7f​", "x" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in tokens.texts_of_ids(tokens.token_ids(docs)).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
