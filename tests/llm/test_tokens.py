from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from tidemark.llm import tokens

from .helpers import ROWS, documents

TINY = [("<unk>", 0.0), ("▁", -3.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -3.5), ("aab", -5.0), ("▁a", -4.5), ("é", -2.0)]


def library(vocab, unk, byte_fallback):
    t = Tokenizer(models.Unigram(vocab, unk, byte_fallback=byte_fallback))
    return lambda s: len(t.encode("▁" + s.replace(" ", "▁")).ids) if s else 0


@settings(max_examples=300, deadline=None)
@given(st.text("abé ▁c漢", max_size=14))
def test_tiny_vocabulary_with_ties(text):
    for fallback in (False, True):
        assert tokens.Counter(TINY, 0, fallback).count(text) == library(TINY, 0, fallback)(text)


PUBLIC = tokens.vocabulary()
COUNTER, LIBRARY = tokens.Counter(*PUBLIC), library(*PUBLIC)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30) | st.text("thering \n🎉é漢", max_size=60))
def test_public_vocabulary(text):
    assert COUNTER.count(text) == LIBRARY(text)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: LIBRARY(r.text or "") for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs).collect()} == want


def test_awkward_rows(spark):
    got = [(r.doc_id, r.n_tokens) for r in tokens.count_tokens(documents(spark)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(((r[0], LIBRARY(r[1] or "")) for r in ROWS), key=key)
    assert tokens.count_tokens(documents(spark, [])).collect() == []


def test_a_long_unbroken_text_takes_little_memory():
    """What is kept goes back by the longest piece: 400,000 characters without a space, known and unknown."""
    import time
    import tracemalloc

    c = tokens.Counter([("<unk>", 0.0), ("a", -1.0), ("ab", -1.5), ("b", -2.0), ("abab", -2.5), ("▁", -3.0)], unk_id=0, byte_fallback=False)
    for text in ("ab" * 200_000, "日" * 400_000):
        tracemalloc.start()
        began = time.time()
        n = c.count(text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == (100_001 if text[0] == "a" else 2)
        assert peak < 12 * len(text) and time.time() - began < 60
