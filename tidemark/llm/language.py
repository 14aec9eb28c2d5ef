"""Language identification: a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

#: Bytes of a window; the state starts afresh in each, and every byte of a text is in one.
WINDOW = 96
HIDDEN = 6
#: Bound on the labelled documents the network is trained on, per language.
TRAIN_DOCS = 400
#: Windows of all documents and languages together, at most (one of each language at least), and of a document.
TRAIN_WINDOWS, PER_DOC = 200_000, 8
STEPS, BATCH, RATE = 260, 96, 0.02


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts: bytes [WINDOW, n], how many count in each, whose they are."""
    sizes = np.array([len(t) for t in texts], np.int64)
    per = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), per)
    flat = np.zeros(int(per.sum()) * WINDOW, np.uint8)
    at = np.concatenate([[0], np.cumsum(per)[:-1]]) * WINDOW
    for a, t in zip(at, texts):
        flat[a : a + len(t)] = np.frombuffer(t, np.uint8)
    nth = np.arange(len(owner)) - np.repeat(at // WINDOW, per)
    used = np.minimum(WINDOW, sizes[owner] - nth * WINDOW)
    return np.ascontiguousarray(flat.reshape(-1, WINDOW).T), used, owner


def _start(classes: int, rng) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p["x" + d] = rng.normal(0, 0.4, (3 * HIDDEN, 256)).astype(np.float32)
        p["u" + d] = rng.normal(0, 0.3, (3 * HIDDEN, HIDDEN)).astype(np.float32)
    p["w"] = rng.normal(0, 0.3, (classes, 2 * HIDDEN)).astype(np.float32)
    p["c"] = np.zeros((classes, 1), np.float32)
    return p


def _gates(table, u, byte, h):
    """One step for many windows: new states and what backpropagation needs of it.

    update and reset gates are logistic, written as a hyperbolic tangent of the half.
    """
    g = table[:, byte]
    a = u @ h
    k = 2 * HIDDEN
    zr = np.tanh((g[:k] + a[:k]) * 0.5) * 0.5 + 0.5
    z, r = zr[:HIDDEN], zr[HIDDEN:]
    n = np.tanh(g[k:] + r * a[k:])
    return n + z * (h - n), (z, r, n, a[k:], h)


def _run(p, d, x, keep):
    """States of one direction at every position: [WINDOW, HIDDEN, n]."""
    steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
    h = np.zeros((HIDDEN, x.shape[1]), np.float32)
    out, tape = np.empty((len(x), HIDDEN, x.shape[1]), np.float32), {}
    for t in steps:
        h, tape_t = _gates(p["x" + d], p["u" + d], x[t], h)
        out[t] = h
        if keep:
            tape[t] = tape_t
    return out, tape


def _probabilities(p, hf, hb):
    """Class probabilities at positions; hf, hb: [..., HIDDEN, n]."""
    w = p["w"]
    s = w[:, :HIDDEN] @ hf + w[:, HIDDEN:] @ hb + p["c"]
    s -= s.max(axis=-2, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(axis=-2, keepdims=True)
    return s


def _gradient(p, x, y):
    """Loss and gradients for windows x [T, n] of classes y, by backpropagation through time."""
    T, n = x.shape
    runs = {d: _run(p, d, x, True) for d in "fb"}
    q = _probabilities(p, runs["f"][0], runs["b"][0])
    loss = -np.log(q[:, y, np.arange(n)] + 1e-9).mean()
    q[:, y, np.arange(n)] -= 1
    q /= T * n
    both = np.concatenate([runs["f"][0], runs["b"][0]], axis=1)
    grad = {"w": np.einsum("tcn,thn->ch", q, both, optimize=True), "c": q.sum(axis=(0, 2))[:, None]}
    down = np.einsum("ch,tcn->thn", p["w"], q, optimize=True)
    for i, d in enumerate("fb"):
        u, gx, gu = p["u" + d], np.zeros_like(p["x" + d]), np.zeros_like(p["u" + d])
        back = np.zeros((HIDDEN, n), np.float32)
        for t in range(T - 1, -1, -1) if d == "f" else range(T):
            z, r, m, a, h = runs[d][1][t]
            dh = back + down[t, i * HIDDEN : (i + 1) * HIDDEN]
            dm = dh * (1 - z) * (1 - m * m)
            dz = dh * (h - m) * z * (1 - z)
            dr = dm * a * r * (1 - r)
            dx = np.concatenate([dz, dr, dm])
            da = np.concatenate([dz, dr, dm * r])
            np.add.at(gx.T, x[t], dx.T)
            gu += da @ h.T
            back = dh * z + u.T @ da
        grad["x" + d], grad["u" + d] = gx, gu
    return loss, grad


def train(texts: list[bytes], labels: list[str], seed: int = 5, steps: int = STEPS) -> dict:
    """A model of the languages in labels from labelled texts or windows of them, by Adam on random windows."""
    langs = sorted(set(labels))
    if len(langs) < 2:
        return {"langs": langs, "p": None}
    rng = np.random.default_rng(seed)
    x, used, owner = _windows(texts)
    full = np.flatnonzero(used == WINDOW) if (used == WINDOW).any() else np.arange(len(used))
    nth = {v: k for k, v in enumerate(langs)}
    y = np.array([nth[v] for v in labels])[owner]
    by = [full[y[full] == k] for k in range(len(langs))]
    by = [b if len(b) else np.flatnonzero(y == k) for k, b in enumerate(by)]
    p = _start(len(langs), rng)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    live = [k for k in range(len(langs)) if len(by[k])]
    for s in range(1, steps + 1):
        at = np.concatenate([rng.choice(by[k], BATCH // len(live) + 1) for k in live])
        _, g = _gradient(p, x[:, at], y[at])
        rate = RATE * min(1, s / 20) * (1 - s / (steps + 1)) ** 0.5
        for k in p:
            gk = np.clip(g[k], -1, 1)
            m[k] = 0.9 * m[k] + 0.1 * gk
            v[k] = 0.99 * v[k] + 0.01 * gk * gk
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-7)).astype(np.float32)
    return {"langs": langs, "p": p}


def document_probabilities(model: dict, texts: list[bytes], block: int = 4096) -> np.ndarray:
    """Mean over all positions of each text of the class probabilities: [texts, classes]."""
    p, k = model["p"], len(model["langs"])
    x, used, owner = _windows(texts)
    total = np.zeros((len(texts), k))
    for b in range(0, x.shape[1], block):
        part, n = x[:, b : b + block], used[b : b + block]
        order = np.argsort(-n, kind="stable")
        part, n = np.ascontiguousarray(part[:, order]), n[order]
        live = np.searchsorted(-n, -np.arange(WINDOW), "left")  # windows that reach each position
        width = part.shape[1]
        hf = np.empty((WINDOW, HIDDEN, width), np.float32)
        h = np.zeros((HIDDEN, width), np.float32)
        for t in range(WINDOW):
            c = live[t]
            h[:, :c], _ = _gates(p["xf"], p["uf"], part[t, :c], np.ascontiguousarray(h[:, :c]))
            hf[t, :, :c] = h[:, :c]
        sums = np.zeros((k, width), np.float32)
        h = np.zeros((HIDDEN, width), np.float32)
        for t in range(WINDOW - 1, -1, -1):
            c = live[t]
            if c:
                h[:, :c], _ = _gates(p["xb"], p["ub"], part[t, :c], np.ascontiguousarray(h[:, :c]))
                sums[:, :c] += _probabilities(p, hf[t, :, :c], h[:, :c])
        o = owner[b : b + block][order]
        for j in range(k):
            total[:, j] += np.bincount(o, sums[j], len(texts))
    return total / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def fit(docs: DataFrame, lang: str = "lang", limit: int = TRAIN_DOCS) -> dict:
    """Train on windows of at most `limit` documents of each language: non-null text and lang, not held out.

    They are those of the smallest hash of id and text, found by a per-language sort in which each
    task keeps `limit` rows. Rows equal in id and text count once, so a language of few documents that
    recur is learned from those, however often they do. Of each come PER_DOC windows from even places over its whole text,
    so the driver receives a bounded number of bytes whatever the texts' sizes. All languages are
    learned: where there are many, each has fewer documents, so that all have TRAIN_WINDOWS.
    """
    from pyspark.sql import Window

    ok = docs.where(F.col("text").rlike(r"\p{L}") & F.col(lang).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ok = ok.select("doc_id", "text", F.col(lang).alias("lang"), F.xxhash64("doc_id", "text", F.lit(3)).alias("r"))
    # a random share of a language's different documents, so that the window below sorts a bounded part of it
    n = written(ok.groupBy("lang").agg(F.approx_count_distinct("r").alias("count")))
    langs = n.count()
    if not langs:
        return train([], [])
    most = max(1, min(limit, TRAIN_WINDOWS // (PER_DOC * langs)))
    at = Window.partitionBy("lang").orderBy("r", "doc_id", "text")
    few = ok.join(F.broadcast(n) if langs <= 100_000 else n, "lang")
    few = few.where(F.pmod(F.col("r"), F.lit(1 << 30)) <= (F.lit(4.0 * most + 64) / F.col("count") * (1 << 30)))
    few = few.groupBy("lang", "r").agg(F.min(F.struct("doc_id", "text")).alias("d")).select("lang", "r", "d.*")
    few = few.withColumn("k", F.row_number().over(at)).where(F.col("k") <= most)
    raw = F.encode("text", "UTF-8")
    size = F.octet_length("text")
    parts = F.least(F.lit(PER_DOC), F.ceil(size / WINDOW).cast("int"))
    # window j of p starts at (size - WINDOW) * j / (p - 1): the first at the start, the last at the end
    start = F.when(parts > 1, F.floor((size - WINDOW) * F.col("j") / (parts - 1))).otherwise(0).cast("int")
    few = few.withColumn("j", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = few.select(F.substring(raw, start + 1, F.lit(WINDOW)).alias("window"), "lang", "k", "j").orderBy("lang", "k", "j").collect()
    return train([bytes(x[0]) for x in rows], [x[1] for x in rows])


def held_out(doc_id):
    """crc32 of the id as text divides by 5; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def predict(docs: DataFrame, model: dict, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with columns pred and score (the mean probability of the language over all bytes).

    Null text or text without a letter: `und`, score 0. With one learned language the answer
    is that, score 1; with none `und`. Empty tables give no rows; repeated rows, null ids and
    further columns pass through as they are (columns of those two names are replaced).
    """
    base = docs.drop(pred, score)
    langs = model["langs"]
    letters_name = free_name(base, "letters")
    base = base.withColumn(letters_name, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    i, j = base.columns.index("text"), len(base.columns) - 1

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                letters = b.column(j).to_numpy(zero_copy_only=False)
                names, scores = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
                idx = np.flatnonzero(letters)
                if len(langs) == 1:
                    names[idx], scores[idx] = langs[0], 1.0
                elif langs and len(idx):
                    texts = [t.encode() for t in b.column(i).take(pa.array(idx)).to_pylist()]
                    q = document_probabilities(model, texts)
                    names[idx] = np.array(langs, object)[q.argmax(1)]
                    scores[idx] = np.clip(q.max(1), 0, 1)
                cols = [*b.columns[:j], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:j], pred, score])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return base.mapInArrow(run, schema + f", `{pred}` string, `{score}` double")
