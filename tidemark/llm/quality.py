"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, free_name, give_back, shared_dir, written

ORDER = 5
#: Text bytes after which a chunk of documents ends; only a longer single text exceeds them.
CHUNK_BYTES = 32 << 20
#: Bytes whose n-grams are sorted at once.
SORT_BYTES = 1 << 20
#: Documents of a language needed for a quantile of its own; fewer use that of all languages.
LEAST_DOCS = 20
#: Bins of the logarithm of perplexity, per unit.
BINS = 2000


def _grams(texts: list[bytes], order: int):
    """The n-grams of all positions of the texts, packed into int64, and the texts' lengths.

    A text is preceded by order-1 zero bytes, so that each of its bytes ends one n-gram; the
    last byte of an n-gram is the lowest of the number, its context the number >> 8.
    """
    pad = b"\0" * (order - 1)
    flat = np.frombuffer(pad + pad.join(texts) if texts else b"", np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.int64), sizes
    n = len(flat) - order + 1
    g = np.zeros(n, np.int64)
    for i in range(order):
        g <<= 8
        g |= flat[i : i + n]
    starts = np.concatenate([[0], np.cumsum(sizes + order - 1)[:-1]])
    keep = np.ones(n, bool)
    for s, k in zip(starts + sizes, range(len(sizes) - 1)):
        keep[s : s + order - 1] = False
    return g[keep], sizes


def _batches(texts: list[bytes]):
    """Runs of texts of about SORT_BYTES."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= SORT_BYTES:
            yield part
            part, n = [], 0
    if part:
        yield part


def _merge(keys, counts):
    """The sums of counts by key."""
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, counts, len(u)).astype(np.int64)


def counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, c): how often each byte n-gram of `order` ends at a byte of the texts, over all rows.

    Every task sums its own texts first, so what is shuffled is its distinct n-grams.
    """

    def run(batches):
        keys, sums, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                for part in _batches([t.encode() for t in b.column(0).slice(at, 1000).to_pylist() if t]):
                    waiting.append(np.unique(_grams(part, order)[0], return_counts=True))
                    if sum(len(x[0]) for x in waiting) > 800_000:
                        keys, sums = _merge(np.concatenate([keys, *(x[0] for x in waiting)]), np.concatenate([sums, *(x[1] for x in waiting)]))
                        waiting = []
        if waiting:
            keys, sums = _merge(np.concatenate([keys, *(x[0] for x in waiting)]), np.concatenate([sums, *(x[1] for x in waiting)]))
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000]), pa.array(sums[i : i + 100_000])], ["g", "c"])
        del keys, sums, waiting
        give_back()

    return texts.select("text").mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def _low(col, n: int):
    """The last n bytes of a packed n-gram."""
    return col.bitwiseAND(F.lit((1 << (8 * n)) - 1))


def model(grams: DataFrame, order: int = ORDER) -> list[dict]:
    """Kneser-Ney tables from the counts of the highest order, as distributed tables.

    [k-1] holds order k: `n` (g, p: its discounted share) and, by context, `ctx` (h, gamma:
    the weight of the next lower order). Below the highest order an n-gram's count is how many
    different bytes precede it; each comes from the next higher table by one sharded
    aggregation. Each order has three discounts from its counts of counts.
    """
    out: list[dict] = []
    c = grams
    for k in range(order, 0, -1):
        c = written(c)
        t = {r["c"]: r["n"] for r in c.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
        n1, n2, n3, n4 = (float(t.get(i, 0)) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = []
        for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
            x = i - (i + 1) * y * b / a if a else 0.5 * i
            d.append(min(max(x, 0.05), i * 0.95))
        h = F.shiftright("g", 8)
        ctx = c.groupBy(h.alias("h")).agg(
            F.sum("c").alias("total"), F.count_if(F.col("c") == 1).alias("a1"), F.count_if(F.col("c") == 2).alias("a2"), F.count_if(F.col("c") >= 3).alias("a3")
        )
        ctx = ctx.withColumn("gamma", (F.lit(d[0]) * F.col("a1") + F.lit(d[1]) * F.col("a2") + F.lit(d[2]) * F.col("a3")) / F.col("total"))
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        n = c.withColumn("h", h).join(ctx.select("h", "total"), "h").select("g", ((F.col("c") - cut) / F.col("total")).alias("p"))
        out.insert(0, {"n": n, "ctx": ctx.select("h", "gamma")})
        if k > 1:
            c = c.groupBy(_low(F.col("g"), k - 1).alias("g")).agg(F.count("*").alias("c"))
    return out


def probabilities(wanted: DataFrame, tables: list[dict]) -> DataFrame:
    """wanted (g: distinct n-grams) -> g, logp, by joins with the sharded tables, order by order.

    Interpolated: p_k = share_k + gamma_k(context) * p_{k-1}, down to 1/256; a context that
    the trusted text lacks passes all weight to the lower order.
    """
    p = wanted.withColumn("p", F.lit(1.0 / 256))
    for k, t in enumerate(tables, 1):
        key, ctx = _low(F.col("g"), k), F.shiftright(_low(F.col("g"), k), 8)
        p = p.withColumn("key", key).withColumn("h", ctx)
        p = p.join(t["n"].select(F.col("g").alias("key"), F.col("p").alias("share")), "key", "left")
        p = p.join(t["ctx"], "h", "left")
        p = p.select("g", (F.coalesce("share", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("p")).alias("p"))
    return p.select("g", F.ln("p").cast("float").alias("logp"))


def perplexities(docs: DataFrame, tables: list[dict], order: int = ORDER, give: tuple[str, ...] = ("id",)) -> DataFrame:
    """docs (text, the columns of give) -> the columns of give, n_bytes, perplexity (null without a byte).

    A task cuts its rows, as they come, into chunks of CHUNK_BYTES of text. It stores each chunk in
    a file of its own in the shared folder and asks once for every distinct n-gram in it. The
    answers are gathered by chunk, in as many partitions as there are chunks; the task that has
    a chunk's answers opens its file and looks up every byte. So no text is shuffled, what
    language-model scoring gathers follows the input, no task holds the model or more than a
    chunk, and nothing is read twice: an attempt that fails leaves files that nobody names.
    """
    folder = shared_dir(docs.sparkSession)
    rows = docs.select(F.col("text").alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(give)])

    def ask(batches):
        import io
        import uuid

        import zstandard
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        held, texts, size = [], [], 0

        def flush():
            nonlocal held, texts, size
            chunk = uuid.uuid4().int >> 65
            out = io.BytesIO()
            with pa.ipc.new_stream(out, held[0].schema) as w:
                for part in held:
                    w.write_batch(part)
            with store.open_output_stream(f"{top}/{chunk:x}") as f:
                f.write(zstandard.ZstdCompressor(level=3).compress(out.getbuffer()))
            del out
            got = [np.zeros(1, np.int64)]  # so that a chunk of empty texts is answered, too
            for some in _batches(texts):
                got.append(np.unique(_grams(some, order)[0]))
                if sum(map(len, got)) > 1_500_000:
                    got = [np.unique(np.concatenate(got))]
            g = np.unique(np.concatenate(got))
            held, texts, size = [], [], 0
            for i in range(0, len(g), 100_000):
                x = g[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), chunk, np.int64)), pa.array(x)], ["chunk", "g"])

        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                raw = [(t or "").encode() for t in part.column(0).to_pylist()]
                n, first = np.cumsum([len(t) for t in raw]), 0
                while first < len(raw):  # as many rows as the chunk has room for, one at least
                    room = CHUNK_BYTES - size + (n[first - 1] if first else 0)
                    upto = max(int(np.searchsorted(n, room, "right")), first + (not held))
                    if upto > first:
                        held.append(part.slice(first, upto - first))
                        texts += raw[first:upto]
                        size += int(n[upto - 1] - (n[first - 1] if first else 0))
                    if upto < len(raw):
                        yield from flush()
                    first = upto
        if held:
            yield from flush()
        give_back()

    asked = written(rows.mapInArrow(ask, "chunk long, g long"))
    chunks = asked.select("chunk").distinct().count()
    known = probabilities(asked.select("g").distinct(), tables)
    answers = asked.join(known, "g").select("chunk", "g", "logp").repartition(max(1, chunks), "chunk")
    kinds = [docs.schema[c].dataType.simpleString() for c in give]
    schema = "".join(f"c{i} {k}, " for i, k in enumerate(kinds)) + "n_bytes long, perplexity double"

    def score(key, answered):
        import zstandard
        from pyarrow import fs

        g = answered.column("g").to_numpy()
        place = np.argsort(g)
        keys, logp = g[place], answered.column("logp").to_numpy()[place]
        store, top = fs.FileSystem.from_uri(folder)
        with store.open_input_stream(f"{top}/{key[0].as_py():x}") as f:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(f.read())
        parts, n, s = [], [], []
        for batch in pa.ipc.open_stream(raw):
            parts.append(batch)
            for some in _batches([(t or "").encode() for t in batch.column(0).to_pylist()]):
                x, k = _grams(some, order)
                u, at = np.unique(x, return_inverse=True)
                lp = logp[np.searchsorted(keys, u)] if len(u) else np.zeros(0, np.float32)
                s.append(np.bincount(np.repeat(np.arange(len(some)), k), lp[at] if len(u) else None, len(some)))
                n.append(k)
        n, s = np.concatenate(n).astype(np.int64), np.concatenate(s)
        per = np.exp(-s / np.maximum(n, 1))
        whole = pa.Table.from_batches(parts).drop_columns(["text"])
        out = whole.append_column("n_bytes", pa.array(n)).append_column("perplexity", pa.array(per, mask=n == 0))
        del raw, parts
        give_back()
        return out

    out = answers.groupBy("chunk").applyInArrow(score, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(give)], "n_bytes", "perplexity")


def thresholds(scored: DataFrame, keep: float) -> DataFrame:
    """(lang, threshold): in each language the perplexity that the share `keep` of its trusted
    documents does not exceed, from counts of fine logarithmic bins, so no language's rows meet
    in one task. Languages (null is one) with fewer than LEAST_DOCS trusted documents get the
    threshold of all. lang "": the threshold of all.
    """
    t = scored.where("trusted and perplexity is not null").select(
        F.coalesce(F.concat(F.lit("l"), F.col("lang")), F.lit("n")).alias("lkey"), F.ceil(F.ln("perplexity") * BINS).alias("bin")
    )
    t = t.groupBy("lkey", "bin").count()
    t = t.unionByName(t.groupBy("bin").agg(F.sum("count").alias("count")).withColumn("lkey", F.lit("")))
    up = Window.partitionBy("lkey").orderBy("bin")
    every = Window.partitionBy("lkey")
    t = t.withColumn("upto", F.sum("count").over(up)).withColumn("n", F.sum("count").over(every))
    t = t.where(F.col("upto") >= F.col("n") * F.lit(keep))
    t = t.groupBy("lkey").agg(F.exp(F.min("bin") / F.lit(float(BINS))).alias("threshold"), F.max("n").alias("n"))
    return t.where((F.col("n") >= LEAST_DOCS) | (F.col("lkey") == "")).select("lkey", "threshold")


ADDED = ("n_bytes", "perplexity", "threshold", "kept")


def names(docs: DataFrame) -> dict[str, str]:
    """What classify calls the columns it adds: their names, with underscores where docs has such."""
    return {c: free_name(docs, c) for c in ADDED}


def classify(
    docs: DataFrame, labels: DataFrame, keep: float = 0.99, slack: float = 1.05, doubt: float = 1.0, order: int = ORDER, columns: list[str] | None = None
) -> DataFrame:
    """docs (doc_id, text, lang, ...), or `columns` of it, with n_bytes, perplexity, threshold and kept.

    Trusted text: all documents that labels (doc_id, quality, toxic) call good and not toxic. A
    fifth of them, by the hash of doc_id, is not trained on and sets the thresholds, for the
    model knows its own text too well. A document is rejected if its perplexity exceeds `slack`
    times the threshold of its language: the quantile `keep` of those perplexities there. A short
    text says little, so the logarithm of its limit is higher by doubt / sqrt(bytes).

    Null and empty texts have no perplexity and are rejected; null lang is a language of its
    own; a null doc_id is never trusted but scored; repeated rows are scored each; a doc_id that
    labels hold twice is trusted if every one of its rows agrees. Without trusted text the
    model is uniform; without any that is held out the threshold is null and every document
    with text kept. Empty tables give no rows. Rows are never numbered: a document's columns
    travel with it to its score. An added column that docs has already is called by names(docs).
    """
    called, out = names(docs), docs.columns if columns is None else columns
    good = labels.groupBy("doc_id").agg(
        (F.min(F.coalesce("quality", F.lit(0))) > 0).alias("ok"), (F.max(F.coalesce("toxic", F.lit(0))) == 0).alias("mild")
    )
    fold = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(5)) == 0
    good = written(good.where("ok and mild and doc_id is not null").select(F.col("doc_id").alias("id"), fold.alias("trusted")))
    side = F.broadcast(good) if good.count() <= BROADCAST_ROWS else good
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    tables = model(counts(texts.join(side.where("not trusted"), "id", "left_semi"), order), order)
    give = list(dict.fromkeys([*out, "doc_id", "lang"]))
    if "text" in give:  # a column of its own, as the text that is scored may not be given
        scored = perplexities(docs, tables, order, tuple(give))
    else:
        scored = perplexities(docs.select("text", *give), tables, order, tuple(give))
    at = {c: f"c{i}" for i, c in enumerate(give)}
    scored = scored.toDF(*at.values(), "n_bytes", "perplexity")
    scored = scored.join(side.withColumnRenamed("id", at["doc_id"]), at["doc_id"], "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    scored = written(scored)
    lang = F.col(at["lang"])
    cut = written(thresholds(scored.select("n_bytes", "perplexity", "trusted", lang.alias("lang")), keep))
    top = cut.where("lkey = ''").first()
    scored = scored.withColumn("lkey", F.coalesce(F.concat(F.lit("l"), lang), F.lit("n")))
    scored = scored.join(cut.where("lkey <> ''"), "lkey", "left")
    scored = scored.withColumn("threshold", F.coalesce("threshold", F.lit(top["threshold"] if top else None).cast("double")))
    most = F.col("threshold") * F.lit(slack) * F.exp(F.lit(doubt) / F.sqrt(F.greatest("n_bytes", F.lit(1))))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= most, F.lit(True))
    scored = scored.withColumn("kept", kept)
    return scored.select(*[F.col(at[c]).alias(c) for c in out], *[F.col(c).alias(called[c]) for c in ADDED])
