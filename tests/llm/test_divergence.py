import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import divergence

from .helpers import ROWS, documents, relayout

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least=10, top=10):
    """rows: (text, lang, source) -> {(lang, source, part, item, value, rank)} by the formulas alone."""
    docs = defaultdict(Counter)
    counts = defaultdict(Counter)
    groups = set()
    for text, lang, source in ((a or "", b or "", c or "") for a, b, c in rows):
        w = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups.add((lang, source))
        docs[lang].update(set(w))
        counts[lang, source].update(w)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        own = sorted(s for x, s in groups if x == lang)

        def p(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * len(kept)) for t in kept}

        ps = {s: p(counts[lang, s]) for s in own}
        q = p(sum((counts[lang, s] for s in own), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pair = [(-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode()) for o in own if o != s]
            term = [(-f(ps[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and ps[s][t] > q[t]]
            for part, x, most in (("pair", pair, None), ("term", term, top)):
                out |= {(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(sorted(x)[:most])}
    return out


def got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, 1, "x", 2) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, term string, total int")


def mixed(n=400):
    words = "Alpha beta GAMMA delta éa Éa ünder 日本 x1y zeta eta theta 日 \U0001f600".split()
    return [(" ".join(words[(i * k + k * k) % len(words)] for k in range(i % 23)), ("en", "de", None)[i % 7 % 3], ("s", "t", None, "é", "z")[i % 11 % 5]) for i in range(n)]


@pytest.mark.parametrize("chunk,cells,held", [(4096, 1 << 20, 300_000), (3, 8, 5)])
def test_equals_brute_force(spark, monkeypatch, chunk, cells, held):
    for k, v in (("CHUNK", chunk), ("CELLS", cells), ("HELD", held)):
        monkeypatch.setattr(divergence, k, v)
    relayout(spark, monkeypatch, divergence)
    rows = mixed()
    assert got(divergence.audit(frame(spark, rows))) == brute(rows)
    # none kept in some language; a source without terms; ties go by UTF-8 bytes
    rows = [("uni que" if i else None, "fr", f"s{i % 3}") for i in range(6)] + [("tie Tie bound", "en", "a")] * 10 + [(None, "en", "b"), ("", "en", "c")]
    assert got(divergence.audit(frame(spark, rows))) == brute(rows)


def test_awkward(spark):
    assert got(divergence.audit(documents(spark), least_docs=1)) == brute([r[1:4] for r in ROWS], 1)
    assert got(divergence.audit(documents(spark, []))) == set()
    assert got(divergence.audit(frame(spark, [(None, None, None)] * 3))) == set()


def test_long_text_is_read_in_pieces(spark, monkeypatch):
    from tidemark.llm import terms

    monkeypatch.setattr(terms, "PIECE", 7)
    text = "One two, threefour five" * 3
    assert sum(terms.words(text.encode(), divergence.LETTERS), []) == [w.encode() for w in TERM.findall(text.lower())]
    assert list(terms.words(b"...", divergence.LETTERS)) == list(terms.words(None, divergence.LETTERS)) == []


def test_scaled_is_exact():
    import numpy as np

    for count, total, v in [(0, 0, 1), (10**13, 3 * 10**13, 10**8), (9 * 10**15, 9 * 10**15, 7), (5, 10**15 + 7, 10**9)]:
        assert divergence.scaled(np.array([count]), total, v)[0] == 1 + 10**9 * (count + 2) // (total + 2 * v)
