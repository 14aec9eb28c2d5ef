"""N-gram Jaccard join by chosen paths: sets split recursively on sampled shared tokens."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, connected_components, numbered, united, written

WORDS = 5
LEAST = 0.8
#: Tokens kept of a set: minima of that many hash functions, coordinates shared at the rate of the Jaccard similarity.
TOKENS = 64
#: Sets a node may hold to be brute-forced; larger ones are split.
SMALL = 1000
#: Rows of the buckets in which small nodes are brute-forced many at a time.
BUCKET = 20_000
#: Share of the pairs at the threshold that the runs are to find, and runs made at a time until they do:
#: as many as trees of six levels need, so that most tables take one round.
RECALL, AT_ONCE = 0.99, 16
#: Levels after which a node that is still large is compared in blocks.
DEPTH = 12
#: Sets of a block when the members of a candidate group are compared exactly, and bytes of its texts.
BLOCK, BLOCK_BYTES = 250, 8 << 20
#: Sets of a block when a group's sketches are compared to find which blocks need comparing.
SKETCH_BLOCK = 4000

_K = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.array([pow(0x100000001B3, i, 1 << 64) for i in range(64)], np.uint64)


def shingles(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes.

    Words are runs of a-z, 0-9 and bytes above 127 of the lower-cased text. A text of fewer
    words than a shingle is one shingle of all it has; one without words has none.
    """
    raw = [t.lower().encode() if t else b"" for t in texts]
    flat = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    if not len(flat):
        return [np.zeros(0, np.uint64) for _ in texts]
    inside = _LETTER[flat]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(start):
        first = np.repeat(start, np.diff(np.append(start, len(flat))))
        pos = np.concatenate([np.zeros(start[0], np.int64), np.arange(start[0], len(flat)) - first])
        term = np.where(inside, (flat.astype(np.uint64) + np.uint64(1)) * _POWERS[pos & 63], np.uint64(0))
        term ^= np.where(pos > 63, _mix(pos.astype(np.uint64)) * inside, np.uint64(0))
        word = _mix(np.add.reduceat(term, start) + (stop - start).astype(np.uint64) * _K)
    else:
        word = np.zeros(0, np.uint64)
    ends = np.cumsum([len(r) + 1 for r in raw])
    n_upto = np.searchsorted(start, ends)
    out, a = [], 0
    for b in n_upto.tolist():
        w = word[a:b]
        a = b
        if not len(w):
            out.append(w)
            continue
        k = min(words, len(w))
        h = np.full(len(w) - k + 1, np.uint64(k))
        for i in range(k):
            h = h * np.uint64(0x100000001B3) + w[i : len(w) - k + 1 + i]
        out.append(np.unique(_mix(h)))
    return out


_SEEDS = _mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * _K)


def _sketches_of(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of TOKENS hash functions over each non-empty set: 32-bit coordinates."""
    flat = np.concatenate(sets)
    low, high = (flat & np.uint64(0xFFFFFFFF)).astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out, h = np.empty((len(sets), TOKENS), np.uint32), np.empty_like(low)
    for i, seed in enumerate(_SEEDS):
        np.multiply(low, np.uint32(seed & np.uint64(0xFFFFFFFF)) | np.uint32(1), out=h)
        np.add(h, high, out=h)
        out[:, i] = np.minimum.reduceat(h, starts)
    return out


def _sketches(words: int):
    """A task function: (row, id, text) -> row, id, two hashes of the whole set (null if it is
    empty), bytes of the text, sketch."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = part.column(2).to_pylist()
                sets = shingles(texts, words)
                has = np.array([len(s) > 0 for s in sets])
                full = [s for s in sets if len(s)]
                one, two, mins = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64), iter([])
                if full:
                    n = np.array([len(s) for s in full], np.uint64)
                    starts = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
                    flat = np.concatenate(full)
                    for out, seed in ((one, np.uint64(11)), (two, np.uint64(1_000_003))):
                        out[has] = _mix(np.add.reduceat(_mix(flat + seed), starts) ^ (n * _K)).view(np.int64)
                    mins = iter([m.tobytes() for m in _sketches_of(full)])
                cols = [part.column(0), part.column(1), pa.array(one, mask=~has), pa.array(two, mask=~has)]
                cols.append(pa.array([len(t or "") for t in texts], pa.int64()))
                cols.append(pa.array([next(mins) if h else None for h in has], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["row", "id", "h1", "h2", "bytes", "sketch"])

    return run


def _children(nodes: np.ndarray, mins: np.ndarray, least: float):
    """Of each (node, set): the coordinates that its node chooses, and the child nodes there.

    A node chooses a coordinate with probability 1 / (least * TOKENS), by a hash of both, so
    that sets alike at least so much share a child with a constant probability.
    """
    h = _mix(nodes.view(np.uint64)[:, None] + np.arange(1, TOKENS + 1, dtype=np.uint64)[None, :] * _K)
    picked = h < np.uint64(min(1.0, 1 / (least * TOKENS)) * float(2**64 - 1))
    at, coord = np.nonzero(picked)
    child = _mix(h[at, coord] ^ (mins[at, coord].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return at, child.view(np.int64)


def limits(least: float) -> tuple[float, float]:
    """(likely, close): the shares of equal coordinates at which a pair is a candidate, and at
    which a set may leave a node with its pivot.

    likely is five deviations under the threshold. What a set links to is in Jaccard distance at
    most 1 - least from it, and so in 1 - least + 1 - close from the pivot: close is what makes
    that a candidate of the pivot, too, with a deviation to spare.
    """
    likely = max(0.1, least - 5 * (least * (1 - least) / TOKENS) ** 0.5)
    return likely, min(1.0, 1 - least + likely + (likely * (1 - likely) / TOKENS) ** 0.5)


def survival(levels: int) -> float:
    """Probability that a pair at the threshold shares a node after so many levels of a run.

    The coordinates that two sets share in a node's choice are one on average, as the hash gives
    Poisson numbers of them: a critical branching process, whose survival after each level is
    1 - exp(-survival before).
    """
    p = 1.0
    for _ in range(levels):
        p = 1 - float(np.exp(-p))
    return p


def runs_for(recall: float, levels: int) -> int:
    """Runs of so many levels that find a pair at the threshold with at least that probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - survival(levels))))


def _as_mins(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, TOKENS)


def candidates(sets: DataFrame, least: float = LEAST, recall: float = RECALL, depth: int = DEPTH, small: int = SMALL) -> DataFrame:
    """sets (set, sketch; sets distinct) -> edges (u, v) that join likely pairs into groups.

    Runs are repeated, AT_ONCE side by side, until they are as many as `recall` needs for trees
    of the depth that the deepest run so far has reached, at any depth. Only sets that shared a
    node deeper than the runs made so far suffice for go into the next ones: a pair with any
    other set was never led that deep, so its runs are enough.
    """
    edges, done, levels, crowds = None, 0, 1, []
    while done < runs_for(recall, levels):
        if done and runs_for(recall, 1) <= done:
            deep = [c.select("set") for level, c in crowds if runs_for(recall, level) > done]
            sets = written(sets.join(functools.reduce(DataFrame.union, deep).distinct(), "set", "left_semi"))
        found, reached = _runs(sets, least, range(done, done + AT_ONCE), depth, small, crowds)
        edges = found if edges is None else edges.unionByName(found)
        done, levels = done + AT_ONCE, max(levels, reached)
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _runs(sets: DataFrame, least: float, numbers: range, depth: int, small: int, crowds: list):
    """(u, v) edges of the runs of these numbers, and the levels of their deepest tree.

    crowds takes (level, rows of its shared nodes) of every level.

    Every level is one distributed pass over all runs: nodes of one set end; nodes of at most
    `small` are brute-forced by sketches; each larger one compares all its sets with one pivot,
    links what is likely similar, lets go of what is close to it (its links lie with those of
    the pivot's group) and is split again on the coordinates that its hash samples. What is
    left at the last level is compared in blocks. So no node, however large, meets in one task.

    A set that was linked carries a set it is joined to by links as its tag. A node whose sets
    all have one tag ends, as they are in one group already. So does one in which at most
    `small` sets are outside the pivot's group: these are compared with all of the node. Else
    sets that are alike a little less than `close` would go through all levels of every run.
    """
    likely, close = limits(least)

    def roots(batches):
        for b in batches:
            mins = _as_mins(b.column(1).to_pylist())
            ids = b.column(0)
            for r in numbers:
                top = np.full(len(mins), _mix(np.array([r + 1], np.uint64))[0]).view(np.int64)
                at, child = _children(top, mins, least)
                yield pa.RecordBatch.from_arrays([pa.array(child), ids.take(pa.array(at))], ["node", "set"])

    level = sets.select("set", "sketch").mapInArrow(roots, "node long, set long").withColumn("tag", F.lit(None).cast("long"))
    found = [sets.select(F.col("set").alias("u"), F.col("set").alias("v")).limit(0)]
    for step in range(depth + 1):
        level = written(level)
        sizes = level.groupBy("node").agg(
            F.count("*").alias("n"),
            F.min(F.struct(F.xxhash64("set"), "set", F.coalesce("tag", "set").alias("tag"))).alias("first"),
            (F.count("tag") == F.count("*")).alias("tagged"), F.min("tag").alias("least"), F.max("tag").alias("most"),
        )
        sizes = sizes.where("n > 1 and not (tagged and least = most)").select("node", "n", F.col("first.set").alias("pivot"), F.col("first.tag").alias("group"))
        crowd = written(level.join(sizes, "node").select("node", "set", "tag", "n", "pivot", "group"))
        crowds.append((step + 1, crowd))
        counts = crowd.agg(F.count_if(F.col("n") <= small), F.count_if(F.col("n") > small)).first()
        if counts[0]:
            found.append(_brute(crowd.where(F.col("n") <= small).select("node", "set"), sets, likely))
        if not counts[1]:
            break
        large = crowd.where(F.col("n") > small)
        if step == depth:
            cells = large.withColumn("blocks", F.ceil(F.col("n") / small).cast("int"))
            cells = cells.withColumn("block", F.pmod(F.xxhash64("set", "node"), F.col("blocks")).cast("int"))
            cells = cells.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            cells = cells.select(F.xxhash64("node", F.least("block", "with"), F.greatest("block", "with")).alias("node"), "set")
            found.append(_brute(cells, sets, likely))
            break
        pivots = large.groupBy("node", "pivot").count().join(sets, F.col("pivot") == F.col("set")).select("node", F.col("sketch").alias("of_pivot"))
        near = large.join(sets, "set").join(pivots, "node")

        def meet(batches):
            for b in batches:
                node, own, pivot, tag, group = b.columns[:5]
                like = (_as_mins(b.column(5).to_pylist()) == _as_mins(b.column(6).to_pylist())).mean(1)
                joined = pc.fill_null(pc.equal(tag, group), False)
                tie = pc.and_not(pa.array(like >= likely), joined)
                out = pc.invert(pc.or_(tie, joined))
                to = pc.if_else(tie, pivot, pa.scalar(None, pa.int64()))
                tag = pc.if_else(tie, group, tag)
                yield pa.RecordBatch.from_arrays([node, own, tag, to, out, pa.array(like < close)], ["node", "set", "tag", "to", "out", "stay"])

        met = written(near.select("node", "set", "pivot", "tag", "group", "sketch", "of_pivot").mapInArrow(meet, "node long, set long, tag long, to long, out boolean, stay boolean"))
        found.append(met.where("to is not null and set <> to").select(F.col("set").alias("u"), F.col("to").alias("v")))
        rest = met.groupBy("node").agg(F.count_if("out").alias("outside"), F.count_if("stay").alias("n")).where("outside > 0")
        few, many = rest.where(F.col("outside") <= small), rest.where(F.col("outside") > small)
        counts = rest.agg(F.count_if(F.col("outside") <= small), F.count_if(F.col("outside") > small)).first()
        if counts[0]:
            found.append(_outside(met.where("stay").join(few, "node").select("node", "set", "out", "n"), sets, likely))
        if not counts[1]:
            break

        def split(batches):
            for b in batches:
                at, child = _children(b.column(0).to_numpy(), _as_mins(b.column(3).to_pylist()), least)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(child), b.column(1).take(take), b.column(2).take(take)], ["node", "set", "tag"])

        staying = met.where("stay").join(many, "node").join(sets, "set")
        level = staying.select("node", "set", "tag", "sketch").mapInArrow(split, "node long, set long, tag long")
    edges = found[0]
    for f in found[1:]:
        edges = edges.unionByName(f)
    return edges, step + 1


def _brute(members: DataFrame, sets: DataFrame, likely: float) -> DataFrame:
    """Likely pairs inside small nodes, as stars of each node's likely groups.

    Nodes are dealt into buckets of many; a bucket compares its rows, in order of nodes, with
    those 1, 2, ... places on as long as they share the node.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        node, ids, mins = pdf["node"].to_numpy(), pdf["set"].to_numpy(), _as_mins(pdf["sketch"])
        label, at = np.arange(len(ids)), np.arange(len(ids))
        for d in range(1, len(ids)):
            at = at[at + d < len(ids)]
            at = at[node[at] == node[at + d]]
            if not len(at):
                break
            for s in range(0, len(at), 50_000):
                i = at[s : s + 50_000]
                like = (mins[i] == mins[i + d]).sum(1) >= likely * TOKENS
                if like.any():
                    label = united(label, i[like], i[like] + d)
        far = np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({"u": ids[far], "v": ids[label[far]]})

    buckets = 1 + members.count() // BUCKET
    dealt = members.withColumn("bucket", F.pmod(F.xxhash64("node", F.lit(13)), F.lit(buckets))).join(sets, "set")
    return written(dealt.groupBy("bucket").applyInPandas(compare, "u long, v long"))


def _outside(members: DataFrame, sets: DataFrame, likely: float) -> DataFrame:
    """Likely pairs of a node with one set or both outside its pivot's group, as stars of likely groups.

    members: node, set, out (outside; few in a node), n (sets of the node). A node is dealt into
    parts of about BUCKET sets, and those outside go to every part.
    """
    parts = F.ceil(F.col("n") / BUCKET).cast("int")
    own = F.array(F.pmod(F.xxhash64("set", F.lit(17)), parts).cast("int"))
    dealt = members.withColumn("part", F.explode(F.when(F.col("out"), F.sequence(F.lit(0), parts - 1)).otherwise(own)))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, mins = pdf["set"].to_numpy(), np.ascontiguousarray(_as_mins(pdf["sketch"]).T)
        label, out = np.arange(len(ids)), np.flatnonzero(pdf["out"].to_numpy())
        for s in range(0, len(out), 64):
            i = out[s : s + 64]
            hits = sum((mins[t, i, None] == mins[t]).astype(np.uint8) for t in range(TOKENS))
            a, b = np.nonzero(hits >= likely * TOKENS)
            label = united(label, i[a], b)
        far = np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({"u": ids[far], "v": ids[label[far]]})

    return written(dealt.join(sets, "set").groupBy("node", "part").applyInPandas(compare, "u long, v long"))


def _blocks(members: DataFrame) -> DataFrame:
    """members (group, set, bytes, sketch, ...) with n, the sets of the group, parts and block.

    A group of up to BLOCK sets and BLOCK_BYTES is block 0. A larger one is cut by the start of the
    sketches, so that near ones lie together, and each part again by hashes of its sets, as often
    as its sets and bytes need.
    """
    sums = members.groupBy("group").agg(F.count("*").alias("n"), F.sum("bytes").alias("sum"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("sum") / BLOCK_BYTES), F.lit(1)).cast("long")
    m = members.join(sums.select("group", "n", parts.alias("parts")), "group")
    m = written(m.withColumn("cell", F.pmod(F.xxhash64(F.substring("sketch", 1, 8)), F.col("parts"))))
    big = m.where("parts > 1")
    cells = big.groupBy("group", "cell").agg(F.count("*").alias("k"), F.sum("bytes").alias("sum"))
    subs = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("sum") / BLOCK_BYTES), F.lit(1)).cast("long")
    big = big.join(cells.select("group", "cell", subs.alias("subs")), ["group", "cell"])
    sub = F.pmod(F.xxhash64("set", F.lit(7)), F.col("subs"))
    big = big.withColumn("block", F.shiftleft("cell", 24) + sub)
    one = m.where("parts = 1").withColumn("block", F.lit(0).cast("long"))
    return one.unionByName(big.select(*one.columns)).drop("cell")


def _verify(members: DataFrame, texts: DataFrame, least: float, words: int) -> DataFrame:
    """Exact links inside candidate groups: (set, links, to).

    members: set, group, weight (its rows), sketch, bytes, row (one of them); texts: row, text. A
    group of one block is compared at once, each text sent once. Of a larger one the sketches are
    compared first, and texts are sent only to pairs of blocks that hold a candidate pair. A task
    gives a row for each set, with the rows it links to and the first set of its part.
    """
    m = written(_blocks(members))
    few = m.count() * 64 <= BROADCAST_ROWS * 16  # a member without its sketch has some 64 bytes
    side = m.select("row", "group", "set", "weight", "block", "parts")
    with_text = texts.join(F.broadcast(side) if few else side, "row")
    one = with_text.where("parts = 1").select("group", F.col("block").alias("lo"), F.col("block").alias("hi"), "set", "weight", "block", "text")
    pairs = written(_likely_blocks(m.where("parts > 1").select("group", "n", "set", "block", "sketch"), limits(least)[0]))
    sides = pairs.select("group", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))
    some = with_text.where("parts > 1").join(sides, ["group", "block"])
    units = one.unionByName(some.select(*one.columns))

    def compare(key, pdf):
        ids, weight, block = pdf["set"].to_numpy(), pdf["weight"].to_numpy(), pdf["block"].to_numpy()
        sh = shingles(pdf["text"].tolist(), words)
        n = np.array([len(s) for s in sh])
        owner = np.repeat(np.arange(len(sh)), n)
        _, token = np.unique(np.concatenate(sh), return_inverse=True)
        common = _common(owner, token, len(sh))
        union = n[:, None] + n[None, :] - common
        near = common >= least * union - 1e-9 * union
        near[np.arange(len(n)), np.arange(len(n))] = False
        if key[1] != key[2]:
            near &= block[:, None] != block[None, :]
        label = united(np.arange(len(n)), *np.nonzero(near))
        keep = np.flatnonzero(near.any(1))
        return pd.DataFrame({"set": ids[keep], "links": (near[keep] * weight[None, :]).sum(1).astype(np.int64), "to": ids[label[keep]]})

    return units.groupBy("group", "lo", "hi").applyInPandas(compare, "set long, links long, to long")


def _likely_blocks(sets: DataFrame, likely: float) -> DataFrame:
    """(group, lo, hi): the pairs of blocks of a group that hold a pair of likely similar sketches.

    sets: group, n (sets of the group), set, block, sketch. A sketch has a quarter of a kilobyte, so
    blocks of SKETCH_BLOCK of them meet in pairs where texts could not.
    """
    s = sets.withColumn("supers", F.ceil(F.col("n") / SKETCH_BLOCK).cast("int"))
    s = s.withColumn("super", F.pmod(F.xxhash64("block", F.lit(3)), F.col("supers")).cast("int"))
    s = s.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("supers") - 1)))
    s = s.select("group", F.least("super", "with").alias("a"), F.greatest("super", "with").alias("b"), "super", "block", "sketch")

    def meet(key, pdf):
        pdf = pdf.sort_values("block", kind="stable")
        mins, block, own = _as_mins(pdf["sketch"]), pdf["block"].to_numpy(), pdf["super"].to_numpy()
        found = set()
        names, first = np.unique(block, return_index=True)
        ends = np.append(first[1:], len(block))
        for x, (a, b) in enumerate(zip(first, ends)):
            found.add((x, x))
            for y in range(x + 1, len(names)):
                if key[1] != key[2] and own[first[x]] == own[first[y]]:
                    continue
                for i in range(a, b, 64):
                    hits = sum((mins[i : min(b, i + 64), None, t] == mins[None, first[y] : ends[y], t]).astype(np.uint8) for t in range(TOKENS))
                    if (hits >= likely * TOKENS).any():
                        found.add((x, y))
                        break
        at = np.array(sorted(found), np.int64).reshape(-1, 2)
        return pd.DataFrame({"group": key[0], "lo": names[at[:, 0]], "hi": names[at[:, 1]]})

    return s.groupBy("group", "a", "b").applyInPandas(meet, "group long, lo long, hi long").distinct()


def _common(owner: np.ndarray, token: np.ndarray, n: int) -> np.ndarray:
    """How many tokens each pair of sets shares, by products of blocks of the incidence matrix.

    Tokens of one set only count in no pair and are left out.
    """
    df = np.bincount(token)
    keep = df[token] > 1
    owner, token = owner[keep], np.cumsum(df > 1)[token[keep]] - 1
    total = np.zeros((n, n), np.float32)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    width = 4096
    for t in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, [t, t + width])
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], token[a:b] - t] = 1
        total += m @ m.T
    return total.astype(np.int64)


def join(docs: DataFrame, least: float = LEAST, words: int = WORDS, recall: float = RECALL, id_col: str = "doc_id", row: str | None = None, small: int = SMALL) -> DataFrame:
    """Near-duplicate classes: one row per row of docs (id_col, text, any others).

    Returns row (its number), id_col, class_id (the smallest id among rows with the same shingle
    set), n_links (rows, other than itself, whose Jaccard similarity of word shingles is `least`
    or more), component_id (the smallest id reachable by links) and kept (true for one row of
    each component, the one of the smallest id).

    The candidates come from chosen-path runs over sketches, as many as `recall` asks for; every
    link is then decided on the whole texts' shingle sets, and so is every likely pair within a
    candidate group. Sets are the same if two 64-bit hashes of them are. Texts without a
    word (null, empty, only signs) have no shingles: they link with nothing and are kept, with
    their own id. A null id is larger than any other; of repeated rows one is kept; an empty
    table gives no rows. row: a column of a written table that numbers its rows; without one,
    ids and texts are numbered and written first.
    """
    base = numbered(docs.select(F.col(id_col).alias("id"), F.col("text").alias("text")), "row") if row is None else docs.select(
        F.col(row).alias("row"), F.col(id_col).alias("id"), F.col("text").alias("text")
    )
    heads = written(base.select("row", "id", "text").mapInArrow(_sketches(words), f"row long, id {base.schema['id'].dataType.simpleString()}, h1 long, h2 long, bytes long, sketch binary"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    classes = heads.where("h1 is not null").groupBy("h1", "h2").agg(
        F.count("*").alias("weight"), F.min(order).alias("first"), F.min("bytes").alias("bytes"), F.min("sketch").alias("sketch")
    )
    classes = numbered(classes, "set")
    groups = connected_components(candidates(classes.select("set", "sketch"), least, recall, small=small)).select(F.col("node").alias("set"), F.col("component").alias("group"))
    members = groups.join(classes.select("set", "weight", "bytes", "sketch", F.col("first.row").alias("row")), "set")
    links = written(_verify(members, base.select("row", "text"), least, words))
    comp = connected_components(links.select(F.col("set").alias("u"), F.col("to").alias("v"))).withColumnRenamed("node", "set")
    total = links.groupBy("set").agg(F.sum("links").alias("links"))
    per = classes.select("set", "h1", "h2", "weight", "first").join(total, "set", "left").join(comp, "set", "left").withColumn("component", F.coalesce("component", "set"))
    per = written(per.select("h1", "h2", "weight", "first", F.coalesce("links", F.lit(0)).alias("links"), "component"))
    best = per.groupBy("component").agg(F.min("first").alias("best"))
    per = per.join(best, "component").select(
        "h1", "h2", F.col("first.id").alias("class_id"), (F.col("weight") - 1 + F.col("links")).alias("n_links"), "best"
    )
    out = heads.select("row", "id", "h1", "h2").join(per, ["h1", "h2"], "left")
    alone = F.col("h1").isNull()
    return out.select(
        "row",
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("component_id"),
        F.when(alone, F.lit(True)).otherwise(F.col("best.row") == F.col("row")).alias("kept"),
    )
