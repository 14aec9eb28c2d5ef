import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing

from .helpers import ROWS, documents


def check(spark, docs, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for doc_id, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            x = np.array(ids[s : s + 2048], "<u4")
            want.append((doc_id, p, s, len(x), zlib.crc32(x.tobytes())))
    got = packing.pack_documents(docs).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for off, n in sorted(x):
            assert off == at
            at += n
        assert at <= 2048
    return len(bins), sum(r[3] for r in want)


def test_awkward_rows(spark):
    check(spark, documents(spark), [(r[0], r[1]) for r in ROWS])


def test_empty(spark):
    assert packing.pack_documents(documents(spark, [])).collect() == []


def test_real_documents_are_nearly_full(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bins, tokens = check(spark, docs, [(r.doc_id, r.text) for r in docs.collect()])
    assert bins <= 1.02 * tokens / 2048 + 1


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=12))
def test_plan_uses_every_item_once(counts):
    used = defaultdict(int)
    for use, bins in packing.plan(counts, 50):
        assert sum(n * k for n, k in use.items()) <= 50
        for n, k in use.items():
            used[n] += k * bins
    assert used == counts


def test_plan_finds_the_fullest_bin():
    assert packing.plan({6: 1, 5: 1, 4: 1, 3: 1, 2: 1}, 10)[0] == ({6: 1, 4: 1}, 1)


def test_bins_are_those_of_exhaustive_minimum_slack():
    """Every bin holds the largest item left and the fullest combination of the others."""
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(150):
        room = rng.randint(6, 40)
        items = sorted(rng.randint(1, room) for _ in range(rng.randint(1, 11)))
        counts = {n: items.count(n) for n in set(items)}
        left = list(items)
        for use, bins in packing.plan(counts, room):
            for _ in range(bins):
                seed = max(left)
                rest = list(left)
                rest.remove(seed)
                fullest = max(seed + sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k) if seed + sum(c) <= room)
                assert sum(n * k for n, k in use.items()) == fullest and use.get(seed)
                for n, k in use.items():
                    for _ in range(k):
                        left.remove(n)
        assert not left


def test_equal_pieces_are_spread(spark):
    """Pieces equal in all columns go to several buckets and still get places of their own."""
    items = spark.createDataFrame([(None, 0, 5, 700)] * 3000, "doc_id long, piece int, ids_crc32 long, length long").repartition(9)
    got = packing.pack(items, ["doc_id", "piece", "ids_crc32"]).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 3000
