"""Documents drawn towards a target distribution: bucketed features, array-scored weights, merged runs."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .mixing import placed
from .terms import letters, words

CHARACTERS = letters("0123456789")
BUCKETS = 10_000
#: Features whose buckets a task remembers at once.
REMEMBER = 300_000
#: Rows that a task merges, about.
ROWS_A_RANGE = 200_000


class Buckets(dict):
    """feature -> bucket, remembered up to REMEMBER features."""

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        self[feature] = b = zlib.crc32(feature) % BUCKETS
        return b


def features(text: bytes | None, longest: int) -> Iterator[tuple[int, list[bytes]]]:
    """(words, features) of a text piece by piece; runs of words go on over the pieces' bounds."""
    before: list[bytes] = []
    for part in words(text, CHARACTERS):
        found, run = list(part), before + part
        for k in range(2, longest + 1):
            found += [b" ".join(run[i : i + k]) for i in range(max(0, len(before) - k + 1), len(run) - k + 1)]
        before = run[max(0, len(run) - longest + 1) :] if longest > 1 else []
        yield len(part), found


def bucket_counts(texts: DataFrame, longest: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; BUCKETS numbers come to the driver."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        seen: Counter = Counter()

        def fold():
            if seen:
                at = np.fromiter((zlib.crc32(k) % BUCKETS for k in seen), np.int64, len(seen))
                np.add.at(total, at, np.fromiter(seen.values(), np.int64, len(seen)))
                seen.clear()

        for batch in batches:
            for t in batch.column(0):
                for _, found in features(t.as_py(), longest):
                    seen.update(found)
                    if len(seen) > REMEMBER:
                        fold()
        fold()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select(texts["text"].cast("binary").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the source), of every bucket."""
    s, t = int(source.sum()), int(target.sum())
    each = [math.floor(1000 * math.log((b + 1) * (s + BUCKETS) / ((a + 1) * (t + BUCKETS)))) for a, b in zip(source.tolist(), target.tolist())]
    return np.array(each, np.int64)


def noise(doc_id, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int, seed: int, least_words: int) -> DataFrame:
    """doc_id, n_features, weight, score, words and row, every partition a run that is written
    sorted: documents of enough words first, by score from the greatest, doc_id (null last) and row."""

    def run(batches):
        bucket = Buckets()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n = total = size = 0
                for k, found in features(text.as_py(), longest):
                    size += k
                    n += len(found)
                    total += int(gain[np.fromiter(map(bucket.__getitem__, found), np.int64, len(found))].sum())
                weight = total // n if n else 0
                out.append((n, weight, weight + noise(doc_id, seed), size))
            cols = [pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_features", "weight", "score", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    s = docs.select(docs["doc_id"], docs["text"].cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_features long, weight long, score long, words long")
    s = s.withColumn("row", F.monotonically_increasing_id())
    return written(s.sortWithinPartitions(F.col("words") < least_words, *_order()))


def _order():
    return F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()


def tournament(runs: list[Iterator]) -> Iterator:
    """The items of sorted runs in one order: a tree whose leaves are the runs' heads and whose inner
    nodes hold the winners below; an item that leaves is replaced along one path to the root."""
    k, end = len(runs), (math.inf,)
    heads = [next(r, end) for r in runs]
    win = [0] * k + list(range(k))

    def play(j: int) -> int:
        a, b = win[2 * j], win[2 * j + 1]
        return b if heads[b] < heads[a] else a

    for j in range(k - 1, 0, -1):
        win[j] = play(j)
    while k and heads[win[1]] is not end:
        i = win[1]
        yield heads[i]
        heads[i] = next(runs[i], end)
        j = (k + i) // 2
        while j:
            win[j] = play(j)
            j //= 2


def merged(batches) -> Iterator[pa.RecordBatch]:
    """Slices of sorted runs, one behind the other, in one order. A run ends where the order breaks."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    doc_id, score, row = (table.column(c).to_pylist() for c in ("doc_id", "score", "row"))
    keys = [(-s, d is None, 0 if d is None else d, r, i) for i, (s, d, r) in enumerate(zip(score, doc_id, row))]
    ends = [i for i in range(1, len(keys)) if keys[i][:4] < keys[i - 1][:4]]
    runs = [iter(keys[a:b]) for a, b in zip([0, *ends], [*ends, len(keys)])]
    yield from table.take(pa.array([k[-1] for k in tournament(runs)])).combine_chunks().to_batches()


def draw(docs: DataFrame, target: DataFrame, share=(10, 100), least_words: int = 20, longest: int = 1, seed: int = 2024) -> DataFrame:
    """A draw without replacement towards the target: doc_id, n_features, weight, score, rank (all long but doc_id).

    docs: doc_id, text; target: text. Features are the runs of 1 to `longest` words, hashed into
    BUCKETS by crc32; a bucket's gain is 1000 ln of its share in the target over that in docs (both
    smoothed by one), floored, and a document's weight the floored mean of its features' gains.
    score adds Gumbel noise from sha256 of seed and doc_id, so the greatest scores are such a draw.
    Of the N documents with at least `least_words` words, floor(share N) are drawn, by score, then the
    smaller doc_id; rank counts them from 1, and is null for the others.

    Each partition of scored documents is written as a sorted run. Scores are whole numbers from a
    range that the gains bound, so counting them finds the score beyond which nothing is read. Slices
    of the runs meet by ranges of (score, doc_id, row), and each is merged by a tournament tree; the
    ranges' sizes (a number each) make places of what they hold, and places up to the draw are ranks.

    Null text has no features, weight 0; null doc_id is hashed as `null` and comes last among equals, repeated
    rows are drawn each, in the order in which they are numbered; a text of any length is read whole,
    in pieces; an empty table gives no rows, an empty target draws by noise and rarity alone.
    """
    gain = gains(bucket_counts(docs, longest), bucket_counts(target, longest))
    rows = scored(docs, gain, longest, seed, least_words)
    full = F.col("words") >= least_words
    counts = sorted(((r["score"], r["n"]) for r in rows.where(full).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn = share[0] * sum(n for _, n in counts) // share[1]
    cut, upto = math.inf, 0
    for s, n in counts:
        if upto >= drawn:
            break
        cut, upto = s, upto + n
    columns = ["doc_id", "n_features", "weight", "score"]
    if not drawn:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    ahead = full & (F.col("score") >= cut)
    ranges = 1 + upto // ROWS_A_RANGE
    in_order = rows.where(ahead).repartitionByRange(ranges, *_order()).mapInArrow(merged, rows.schema)
    place = F.col("position") + 1
    first = placed(in_order, "position").select(*columns, F.when(place <= drawn, place).alias("rank"))
    return first.unionByName(rows.where(~ahead).select(*columns, F.lit(None).cast("long").alias("rank")))
