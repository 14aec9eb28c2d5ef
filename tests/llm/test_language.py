import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import language

from .helpers import ROWS, documents


def loop(model, text):
    """Every gate of every byte written out, one window after the other."""
    p, H, b = model["p"], language.HIDDEN, text.encode()
    sig = lambda x: 1 / (1 + np.exp(-x))
    out = []
    for at in range(0, len(b), language.WINDOW):
        w, states = b[at : at + language.WINDOW], {}
        for d in "fb":
            h, got = np.zeros(H), []
            for c in w if d == "f" else reversed(w):
                g, a = p["x" + d][:, c].astype(float), p["u" + d] @ h
                z, r = sig(g[:H] + a[:H]), sig(g[H : 2 * H] + a[H : 2 * H])
                n = np.tanh(g[2 * H :] + r * a[2 * H :])
                h = (1 - z) * n + z * h
                got.append(h)
            states[d] = got if d == "f" else got[::-1]
        for f, k in zip(states["f"], states["b"]):
            s = p["w"] @ np.concatenate([f, k]) + p["c"][:, 0]
            e = np.exp(s - s.max())
            out.append(e / e.sum())
    return np.mean(out, 0)


def test_probabilities_equal_a_plain_loop():
    rng = np.random.default_rng(1)
    model = {"langs": ["a", "b", "c"], "p": language._start(3, rng)}
    texts = ["x", "naïve " * 40, "ab" * 48, "z" * 200, "y" * 95]
    got = language.document_probabilities(model, [t.encode() for t in texts], block=3)
    for g, t in zip(got, texts):
        np.testing.assert_allclose(g, loop(model, t), atol=1e-5)


def test_gradient_equals_differences(monkeypatch):
    rng = np.random.default_rng(2)
    p = {k: v.astype(np.float64) for k, v in language._start(3, rng).items()}
    x, y = rng.integers(0, 256, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    monkeypatch.setattr(np, "float32", np.float64)  # the arrays it makes, for sharp differences
    _, g = language._gradient(p, x, y)
    for k in ("xf", "ub", "w", "c"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        was, e = p[k][i], 1e-5
        p[k][i] = was + e
        up = language._gradient(p, x, y)[0]
        p[k][i] = was - e
        down = language._gradient(p, x, y)[0]
        p[k][i] = was
        assert abs((up - down) / (2 * e) - g[k][i]) < 1e-5 + 1e-3 * abs(g[k][i])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predict(docs, language.fit(docs)).withColumn("held_out", language.held_out(F.col("doc_id"))).collect()
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    hit = [r.lang == r.lang_pred for r in got if r.held_out and r.lang and re.search(r"[^\W\d_]", r.text or "")]
    assert np.mean(hit) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_awkward_rows(spark):
    docs = documents(spark)
    got = language.predict(docs, language.fit(docs)).collect()
    assert len(got) == len(ROWS)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (2, 3, 4))
    assert all(r.lang_pred in ("en", "fr", "de") for r in got if r.doc_id in (1, 5, 6, 7))


def test_empty_and_unlabelled(spark):
    docs = documents(spark, [])
    assert language.predict(docs, language.fit(docs)).collect() == []
    docs = documents(spark, [(1, "some words", None, "a")])
    assert [r.lang_pred for r in language.predict(docs, language.fit(docs)).collect()] == ["und"]


def test_rows_that_recur_do_not_crowd_out_a_language(spark):
    """4,000 equal German rows beside 500 English ones: whatever the text's hash, German is learned."""
    english = [(i, f"the cat number{i} sat there with {i % 7} others and looked at the rain", "en") for i in range(2, 502)]
    for k in range(6):
        same = [(1, f"Der Hund {'x' * k} läuft über die große Straße nach Köln", "de")] * 4000
        docs = spark.createDataFrame(same + english, "doc_id long, text string, lang string")
        assert sorted(language.fit(docs)["langs"]) == ["de", "en"]
