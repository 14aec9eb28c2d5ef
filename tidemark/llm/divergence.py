"""How far sources of a language lie apart, by what they say: integer-coded terms, dense vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .terms import letters, words

LETTERS = letters()
#: Terms with counts that a task holds before it passes them on.
HELD = 300_000
#: Terms of one chunk, and cells (sources x terms) of it that are compared at once.
CHUNK, CELLS = 4096, 1 << 20
#: Copies of a language's sources, so that the chunks of one language meet them in many tasks.
DEALT = 64
SCALE = 1000  # thrice: 10^9, in steps that 64 bits hold


def counted(batches) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs), summed within a task as far as HELD allows."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def out():
        for (lang, source), (n, docs) in groups.items():
            keys = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array([source] * len(keys), pa.string()), pa.array(keys, pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([docs[k] for k in keys], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        groups.clear()

    for batch in batches:
        langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for i, group in enumerate(zip(langs, sources)):
            n, docs = groups.setdefault(group, (Counter(), Counter()))
            before, seen = len(n), set()
            for part in words(texts[i].as_py(), LETTERS):
                n.update(part)
                seen.update(part)
            docs.update(seen)
            held += len(n) - before
            if held > HELD:
                yield from out()
                held = 0
    yield from out()


def kept_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, source, term (bytes), n and `first` (one row a term of a language), for the terms that a language keeps; written.

    Rows meet by all three first, so a frequent term is spread over its sources and what meets by
    term has a row a source.
    """
    d = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source")], docs["text"].cast("binary").alias("text"))
    c = d.mapInArrow(counted, "lang string, source string, term binary, n long, docs long")
    c = c.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    c = c.withColumn("all_docs", F.sum("docs").over(term)).withColumn("first", F.min("source").over(term) == F.col("source"))
    return written(c.where(F.col("all_docs") >= least_docs).select("lang", "source", "term", "n", "first"))


def encoded(batches) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lang, term) -> chunks: a row with a sorted array of terms, whose places are
    the ids, and every count as (place of its source in `sources`, id, n)."""
    rows: list[list] = [[], [], [], []]  # lang, source, term, n of the chunk in the making
    terms: list[bytes] = []

    def out():
        lang, source, term, n = rows
        names = sorted(set(source))
        place = {s: i for i, s in enumerate(names)}
        known = np.empty(len(terms), object)
        known[:] = terms
        asked = np.empty(len(term), object)
        asked[:] = term
        ids = np.searchsorted(known, asked)
        one = [pa.array([lang[0]]), pa.array([terms], pa.list_(pa.binary())), pa.array([names], pa.list_(pa.string())), *[pa.array([x], pa.list_(t)) for x, t in (([place[s] for s in source], pa.int32()), (ids, pa.int32()), (n, pa.int64()))]]
        for x in rows:
            x.clear()
        terms.clear()
        return pa.RecordBatch.from_arrays(one, ["lang", "terms", "names", "who", "which", "n"])

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if terms and (row[0] != rows[0][0] or len(terms) == CHUNK and row[2] != terms[-1]):
                yield out()
            if not terms or terms[-1] != row[2]:
                terms.append(row[2])
            for x, v in zip(rows, row):
                x.append(v)
    if terms:
        yield out()


def scaled(count: np.ndarray, total, vocabulary: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 vocabulary)), exactly: long division by thousands."""
    of = np.asarray(total, np.int64) + 2 * vocabulary
    rest, out = count.astype(np.int64) + 2, np.zeros(np.broadcast_shapes(count.shape, of.shape), np.int64)
    for _ in range(3):
        rest = rest * SCALE
        out = out * SCALE + rest // of
        rest = rest % of
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def compared(top: int):
    """Chunks with their language's sources -> rows (lang, source, part, item, value): of each pair of
    sources the sum over the chunk, of each source its `top` terms in it."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, terms, names, vocabulary, total, sources, totals = (batch.column(c)[i].as_py() for c in ("lang", "terms", "names", "vocabulary", "total", "sources", "totals"))
                who, which, n = (batch.column(c)[i].values.to_numpy() for c in ("who", "which", "n"))
                place = {s: k for k, s in enumerate(sources)}
                group = np.array([place[s] for s in names], np.int64)[who]
                of, pair, best = np.array(totals, np.int64)[:, None], np.zeros((len(sources),) * 2, np.int64), [[] for _ in sources]
                width = max(1, CELLS // len(sources))
                for at in range(0, len(terms), width):
                    here = (which >= at) & (which < at + width)
                    size = min(width, len(terms) - at)
                    # one bin for each source and id; sums below 2^53 are exact
                    cells = np.bincount(group[here] * size + which[here] - at, n[here], len(sources) * size).astype(np.int64).reshape(len(sources), size)
                    p, q = scaled(cells, of, vocabulary), scaled(cells.sum(0), total, vocabulary)
                    for a in range(len(sources)):
                        pair[a, a + 1 :] += apart(p[a], p[a + 1 :]).sum(1)
                        ids = np.flatnonzero((cells[a] > 0) & (p[a] > q))
                        f = apart(p[a, ids], q[ids])
                        lead = np.lexsort((ids, -f))[:top]
                        best[a] += zip((-f[lead]).tolist(), (ids[lead] + at).tolist())
                out = [(s, "pair", sources[b].encode(), int(pair[a, b])) for a, s in enumerate(sources) for b in range(a + 1, len(sources))]
                out += [(s, "term", terms[k], -v) for s, x in zip(sources, best) for v, k in sorted(x)[:top]]
                if out:
                    s, part, item, value = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(s)), pa.array(s), pa.array(part), pa.array(item, pa.binary()), pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])

    return run


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """What sets the sources of a language apart: lang, source, part, item, value, rank.

    docs: text, lang, source; null reads ''. Terms are runs of letters, those of ASCII lower-cased.
    A language keeps the terms in at least `least_docs` of its documents (V of them). A group gives a
    kept term with `count` of the N occurrences of kept terms p = 1 + floor(10^9 (count + 2) / (N + 2V)),
    and two such numbers lie f = floor((p - q)^2 / (p + q)) apart. Part `pair`: every other source
    of the language with f summed over all kept terms (0 without any). Part `term`: the `top` terms
    that the source has and gives more than its language does, by f. Ranks go by value, greatest
    first, then by the item's UTF-8 bytes.

    Kept terms are sorted by language and bytes and coded, in chunks of CHUNK, by their places in the
    chunk's sorted array; a source's counts are a dense vector over it. Neither the vocabulary nor a
    language meets in one task; what grows in a task is sources x CHUNK in blocks of CELLS, and the
    result itself holds every pair of a language's sources. All sums are exact up to 2^53 occurrences.
    Repeated rows count each; an empty table gives no rows; other columns are ignored.
    """
    kept = kept_counts(docs, least_docs)
    groups = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("vocabulary"))
    nought = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    each = F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total"))))
    langs = groups.join(sums, ["lang", "source"], "left").groupBy("lang").agg(nought("vocabulary").alias("vocabulary"), nought("total").alias("total"), each.alias("each"))
    langs = written(langs.select("lang", "vocabulary", "total", F.col("each.source").alias("sources"), F.col("each.total").alias("totals")))

    in_order = kept.select("lang", "source", "term", "n").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source")
    chunks = in_order.mapInArrow(encoded, "lang string, terms array<binary>, names array<string>, who array<int>, which array<int>, n array<long>")
    chunks = chunks.withColumn("dealt", F.pmod(F.xxhash64(F.get("terms", F.lit(0))), F.lit(DEALT)).cast("int"))
    copies = langs.where("vocabulary > 0").withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    found = chunks.join(copies, ["lang", "dealt"]).mapInArrow(compared(top), "lang string, source string, part string, item binary, value long")
    found = written(found)

    others = F.explode(F.filter("sources", lambda s: s > F.col("source")))
    none = langs.where("vocabulary = 0").select("lang", F.explode("sources").alias("source"), "sources").select("lang", "source", others.alias("item"), F.lit(0).cast("long").alias("value"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", F.col("item").cast("string").alias("item")).agg(F.sum("value").alias("value")).unionByName(none)
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    terms = found.where("part = 'term'").withColumn("item", F.col("item").cast("string")).withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(terms.select("lang", "source", "part", "item", "value", "rank"))
