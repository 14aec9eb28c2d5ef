"""Best-fit packing of tokenised documents by minimum bin slack."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, numbered

CAPACITY = 2048
#: Words whose ids a worker remembers at once; it starts afresh beyond. They stay with the worker
#: between tasks, some 250 bytes each.
REMEMBER = 800_000
#: Texts of these characters only split at white space alike before and after normalising.
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff]*")
#: What the vocabulary's model takes apart in such texts, and the mark of a token that ends it.
UNITS, UNIT_END = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+"), "</w>"


@lru_cache(maxsize=2)
def _tokenizer(path: str | None):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import pre_tokenizers

    tok = Tokenizer.from_file(path)
    bare = Tokenizer(tok.model)  # for units, which are normalised and apart already
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ends = np.zeros(tok.get_vocab_size(), bool)
    for token, i in tok.get_vocab().items():
        ends[i] = token.endswith(UNIT_END)
    return tok, bare, ends, {}


def _unit_ids(bare, ends, units: list[str]):
    """Ids of each unit as bytes. Many are encoded as one text and cut where a unit ends."""
    for i in range(0, len(units), 2000):
        part = units[i : i + 2000]
        ids = np.array(bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
        stop = (np.flatnonzero(ends[ids]) + 1) * 4
        if len(stop) == len(part):
            raw, at = ids.tobytes(), 0
            for u, e in zip(part, stop.tolist()):
                yield u, raw[at:e]
                at = e
        else:
            for u in part:
                yield u, np.array(bare.encode(u, add_special_tokens=False).ids, "<u4").tobytes()


def encode(texts: list[str | None], path: str | None = None, remember: int = REMEMBER) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers, equal to the library's own.

    The vocabulary's model never joins what white space separates, so the ids of a plain
    text are those of its words, of which most recur. Other texts go to the library whole.
    """
    tok, bare, ends, memo = _tokenizer(path)
    split: list[list[str] | None] = []
    for t in texts:
        if t and PLAIN.fullmatch(t) and "<|" not in t:
            split.append(t.lower().split())
        else:
            split.append(None)
    words = set().union(*filter(None, split))
    new = words.difference(memo)
    if new:
        if len(memo) + len(new) > remember:
            memo.clear()
            new = words
        mixed = {w: UNITS.findall(w) for w in new if not w.isalpha()}
        units = new.difference(mixed).union(*mixed.values()).difference(memo)
        memo.update(_unit_ids(bare, ends, list(units)))
        for w, us in mixed.items():
            memo[w] = b"".join(map(memo.__getitem__, us))
    odd = [t or "" for t, ws in zip(texts, split) if ws is None]
    whole = iter([np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(odd, add_special_tokens=False)])
    get = memo.__getitem__
    return [next(whole) if ws is None else b"".join(map(get, ws)) for ws in split]


def pieces(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY, ids: bool = False, remember: int = REMEMBER) -> DataFrame:
    """Documents (doc_id, text) as pieces of at most `capacity` tokens.

    Returns doc_id, piece, start, length, ids_crc32 and, if asked, ids (binary, little-endian
    unsigned 32-bit). Every document ends in end_id; null or empty text is that id alone.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 500):
                part = texts.slice(at, 500).to_pylist()
                rows, out = [], []
                for i, x in enumerate(encode(part, path, remember)):
                    x += end_id.to_bytes(4, "little")
                    for p, b in enumerate(range(0, len(x), 4 * capacity)):
                        y = x[b : b + 4 * capacity]
                        rows.append(at + i)
                        out.append((p, b // 4, len(y) // 4, zlib.crc32(y), y))
                p, s, n, c, y = zip(*out)
                cols = [doc_ids.take(pa.array(rows)), pa.array(p, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if ids:
                    cols.append(pa.array(y, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bins for so many items of each length: [({length: items in the bin}, number of such bins)].

    Minimum bin slack: each bin holds the largest item left and, of what is left, the
    combination that fills the rest best, found as the highest reachable sum by a bitset
    over all available lengths; then it is removed. As many bins of one make are filled as
    the counts allow, so the steps follow the number of lengths, not of items.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    while left:
        seed = max(left)
        room = capacity - seed
        have = dict(left)
        have[seed] -= 1
        mask, reach, steps = (1 << (room + 1)) - 1, 1, []
        for n in sorted(x for x in have if x <= room and have[x]):
            copies, k = min(have[n], room // n), 1
            while copies:
                k = min(k, copies)
                steps.append((n, k, reach))
                reach = (reach | reach << (n * k)) & mask
                copies -= k
                k *= 2
        fill, use = reach.bit_length() - 1, {seed: 1}
        for n, k, before in reversed(steps):
            if fill >= n * k and before >> (fill - n * k) & 1:
                fill -= n * k
                use[n] = use.get(n, 0) + k
        bins = min(left[n] // k for n, k in use.items())
        out.append((use, bins))
        for n, k in use.items():
            left[n] -= k * bins
            if not left[n]:
                del left[n]
    return out


def pack(items: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """items with a `length` of 1 to capacity -> with sequence_id and offset.

    The driver sees how many items have each length (capacity numbers at most) and plans the
    bins. Items of one length are interchangeable: each is numbered within its length, by
    buckets so that a length of any share of the rows is spread, and finds its place in the plan.
    """
    row = free_name(items, "row")
    t = numbered(items, row)
    buckets = 1 + t.count() // 50_000
    # rows equal in all of `order` are dealt over the buckets by the number they are written with
    t = t.withColumn("bucket", F.pmod(F.xxhash64(*order, row), F.lit(buckets)))
    sums = t.groupBy("length", "bucket").count()
    made = plan({r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    t = t.join(sums, ["length", "bucket"])
    inside = Window.partitionBy("length", "bucket").orderBy(*order)
    t = t.withColumn("rank", F.col("base") + F.row_number().over(inside) - 1).drop("bucket", "base")

    where: dict[int, list[list[int]]] = {}
    first_bin, used = 0, {}
    for use, bins in made:
        place = 0
        for n, k in use.items():
            where.setdefault(n, []).append([used.get(n, 0), first_bin, k, place])
            used[n] = used.get(n, 0) + k * bins
            place += n * k
        first_bin += bins
    tables = {n: np.array(x, np.int64).T for n, x in where.items()}

    def place_all(batches):
        for b in batches:
            n, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for x in np.unique(n):
                at = np.flatnonzero(n == x)
                starts, bins, k, place = tables[int(x)]
                j = np.searchsorted(starts, r[at], "right") - 1
                seq[at] = bins[j] + (r[at] - starts[j]) // k[j]
                off[at] = place[j] + (r[at] - starts[j]) % k[j] * x
            b = b.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq), pa.array(off)], [*b.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return t.select(*items.columns, "rank").mapInArrow(place_all, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, ids: bool = False, remember: int = REMEMBER) -> DataFrame:
    """All documents in as few sequences of `capacity` tokens as minimum bin slack finds.

    docs: doc_id, text. One row per piece: doc_id, piece, start, length, ids_crc32 (, ids),
    sequence_id, offset. Only documents longer than a sequence are cut. Null or empty text is
    one piece of the end id; null doc_ids and repeated rows are packed like any other; an empty
    table gives no rows; other columns are ignored.
    """
    return pack(pieces(docs, path, capacity=capacity, ids=ids, remember=remember), ["doc_id", "piece", "ids_crc32"], capacity)
