"""Vectors: near-duplicates by an exact metric range join, neighbours by balanced posting lists."""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import connected_components, numbered, united, written

#: Bound on the sample that pivots and centroids are fitted to, and on their number.
SAMPLE_ROWS, MOST_CENTRES = 20_000, 4096
#: Rows that a cell should be home to, and cells at most.
CELL_ROWS, MOST_CELLS = 6000, 256
#: Rows of a home block and of a block of visitors: two blocks are one unit of comparing, whatever a cell holds.
HOME_BLOCK, GUEST_BLOCK = 8000, 12_000
#: Home rows for an inner pivot, and distances to inner pivots at most: a unit's home rows are cut once
#: more by pivots of their own, and only cells in reach are compared.
INNER_ROWS, INNER_DISTANCES = 5, 1 << 24
#: What stands for a null id while neighbours are sought.
NO_ID = -(1 << 63)
#: Share of the sample that a ball must hold to be a cell whose rows all link with each other.
CORE_SHARE = 0.002


def usable(col):
    """Not null, some component not zero, all components there and finite."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return col.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(col, lambda x: x != 0)


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int | None = None) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, dims or 1))


def _rows(series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in series])


def _sample(vectors: DataFrame, column: str, rows: int) -> np.ndarray:
    """At most `rows` vectors, those of the smallest hashes; a bound, not a share."""
    few = vectors.select(column).distinct().orderBy(F.xxhash64(column), column).limit(rows).collect()
    return np.array([r[0] for r in few], np.float64)


def _kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([_squared(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


# -- near-duplicates -----------------------------------------------------------------------


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None] if len(x) else x


def _places(x: np.ndarray, pivots: np.ndarray, radius: float):
    """Of unit vectors: their home cell, and (row, cell) of those they visit.

    Home is the nearest pivot. If x with home i has a neighbour y within the radius r, then
    d(y, p_i) <= d(x, p_i) + r and d(x, p_j) <= d(y, p_j) + r, so d(y, p_i) <= d(y, p_home) + 2r;
    in Euclidean space the distance of y to the plane between the pivots must also be within r,
    the sharper bound. y visits each such cell, but only those of smaller number than its home:
    the pair meets in the smaller of the two homes.
    """
    d2 = _squared(x, pivots)
    home = d2.argmin(1)
    own = d2[np.arange(len(x)), home]
    between = np.sqrt(_squared(pivots, pivots))
    plane = (d2 - own[:, None]) <= 2 * (radius + 1e-9) * between[home] + 1e-9
    near = np.sqrt(d2) <= np.sqrt(own)[:, None] + 2 * radius + 1e-9
    smaller = np.arange(len(pivots))[None, :] < home[:, None]
    return home, *np.nonzero(plane & near & smaller)


def _cores(sample: np.ndarray, radius: float) -> np.ndarray:
    """Centres of balls of half the radius, disjoint in the sample, that hold CORE_SHARE of it.

    All rows of such a ball are links of each other, so a hot group of near copies is counted
    by its centre and is never compared pair by pair. Candidates are centroids of the sample.
    """
    least, left, found = max(16, int(CORE_SHARE * len(sample))), sample, []
    while len(left) >= least:
        c = _unit(_kmeans(left, min(128, max(1, len(left) // 16)), 4))
        inside = _squared(left, c) <= (radius / 2 - 1e-7) ** 2
        held = inside.sum(0)
        took = np.zeros(len(left), bool)
        for j in np.argsort(-held, kind="stable"):
            free = inside[:, j] & ~took
            if held[j] >= least and free.sum() >= least:
                found.append(c[j])
                took |= inside[:, j]
        if not took.any():
            break
        left = left[~took]
    return np.array(found).reshape(-1, sample.shape[1])


def _cells(cores: np.ndarray, reach: np.ndarray, pivots: np.ndarray, radius: float):
    """A task function: (set, copies, v) -> cell, home, id, copies, v, links.

    The cores are the first cells. A row in a core is at home in the nearest one. Any row with a
    home of larger number looks at each core by the triangle inequality: beyond the core's reach
    plus the radius it links with nothing there; within the radius less the reach it links with
    all, which a row without a vector says; between them it visits. Other rows are at home with
    their nearest pivot and visit as _places says.
    """
    k = len(cores)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                x = _unit(_matrix(part.column(2)))
                home, rows, cells = _places(x, pivots, radius)
                home, cells = home + k, cells + k
                whole = np.zeros((2, 0), np.int64)
                if k:
                    d = np.sqrt(_squared(x, cores))
                    near = d.argmin(1)
                    inside = d[np.arange(len(x)), near] <= radius / 2 - 1e-7
                    keep = ~inside[rows]
                    rows, cells = rows[keep], cells[keep]
                    home = np.where(inside, near, home)
                    before = np.arange(k)[None, :] < home[:, None]
                    every = before & (d <= radius - reach[None, :] - 1e-7)
                    some = before & ~every & (d <= radius + reach[None, :] + 1e-7)
                    whole = np.array(np.nonzero(every))
                    r, c = np.nonzero(some)
                    rows, cells = np.concatenate([rows, r]), np.concatenate([cells, c])
                for take, cell, full in ((np.concatenate([np.arange(len(x)), rows]), np.concatenate([home, cells]), False), (whole[0], whole[1], True)):
                    at_ = pa.array(take)
                    v = pa.nulls(len(take), part.schema.field(2).type) if full else part.column(2).take(at_)
                    cols = [pa.array(cell.astype(np.int32)), pa.array(home[take].astype(np.int32)), part.column(0).take(at_), part.column(1).take(at_), v]
                    yield pa.RecordBatch.from_arrays(cols, ["cell", "home", "id", "copies", "v"])

    return run


def _core_reach(classes: DataFrame, cores: np.ndarray, radius: float) -> np.ndarray:
    """The distance of each core's farthest row from its centre: one small row a task and core."""

    def far(batches):
        top = np.zeros(len(cores))
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                d = np.sqrt(_squared(_unit(_matrix(b.column(0).slice(at, 2000))), cores))
                near = d.argmin(1)
                own = d[np.arange(len(d)), near]
                inside = own <= radius / 2 - 1e-7
                np.maximum.at(top, near[inside], own[inside])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cores))), pa.array(top)], ["core", "far"])

    found = classes.select("v").mapInArrow(far, "core long, far double").groupBy("core").agg(F.max("far").alias("far"))
    return np.array([r["far"] for r in found.orderBy("core").collect()])


def link(vectors: DataFrame, id_col: str, vec_col: str, least: float = 0.9, pivots: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) for every row, linked by cosine >= least, exactly.

    Equal vectors are one class: pairs are sought between distinct vectors only, and a class
    counts as often as it has rows. Unit vectors within the Euclidean radius of the cosine
    are found by cells around pivots, which join independently: the triangle inequality says
    which cells a row visits. Dense balls of half the radius are cells of their own whose rows
    all link with each other, uncompared. Inside a cell pivots of its own cut once more, so that
    few pairs are compared; a cell of any size is compared in pairs of blocks, so no task holds
    more than two blocks. A task gives a row for each vector, not for each pair.

    Vectors that are null, zero, or hold null or non-finite components link with nothing;
    component_id is then their id. Vectors of differing length never link. Repeated ids count as
    rows; a null id links like any other row but is nobody's component_id unless alone. An
    empty table gives no rows.
    """
    # single precision stays so wherever rows travel; tasks compute in double precision
    kind = vectors.schema[vec_col].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = F.col(vec_col) if single else F.transform(F.col(vec_col), lambda x: x.cast("double"))
    base = written(vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), usable(F.col(vec_col)).alias("ok")))
    # a class is a vector, component for component; equal ones have cosine 1
    classes = base.where("ok").groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    classes = numbered(classes.withColumn("n", F.size("v")), "class")
    parts = [r["n"] for r in classes.select("n").distinct().collect()]
    out = base.select("vec_id", F.when(F.col("ok"), F.col("v")).alias("v"))
    if not parts:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = [_link_classes(classes.where(F.col("n") == n).select("class", "copies", "v"), least, pivots) for n in parts]
    found = functools.reduce(DataFrame.unionByName, found).where("class >= 0")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("class").alias("u"), F.col("to").alias("v"))).withColumnRenamed("node", "class")
    per = classes.select("class", "v", "copies", "first").join(links, "class", "left").join(comp, "class", "left")
    per = written(per.withColumn("component", F.coalesce("component", "class")))
    least_id = per.groupBy("component").agg(F.min("first").alias("component_id"))
    per = per.join(least_id, "component").select(
        "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), "component_id"
    )
    out = out.join(per, "v", "left")
    own = F.coalesce("component_id", "vec_id").alias("component_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )


def _near_pairs(x: np.ndarray, y: np.ndarray, rows: np.ndarray, cols: np.ndarray, least: float):
    """Arrays (i, j) of the pairs of unit vectors x with cosine >= least between rows and cols, which may
    start with rows themselves; each pair once.

    Single precision (y) finds them, with a margin for its rounding, which grows with the length;
    double precision decides.
    """
    if not len(rows) or not len(cols):
        return rows[:0], cols[:0]
    margin = (x.shape[1] + 8) * 1.2e-7
    at, to = np.divmod(np.flatnonzero(y[rows] @ y[cols].T >= np.float32(least - margin)), len(cols))
    i, j = rows[at], cols[to]
    if cols[0] == rows[0]:
        once = (to >= len(rows)) | (to > at)
        i, j = i[once], j[once]
    exact = [np.einsum("nd,nd->n", x[i[k : k + 100_000]], x[j[k : k + 100_000]]) for k in range(0, len(i), 100_000)]
    ok = np.concatenate(exact) >= least if exact else np.zeros(0, bool)
    return i[ok], j[ok]


def _inner(x: np.ndarray, own: int, among: bool, radius: float):
    """The first `own` rows of a unit cut by pivots fitted to them: (cells as arrays of these rows, for each the
    rows to meet). The rows after them, and among themselves the own ones if asked, find the cells they meet.

    A row of cell i can only have a neighbour in cell j if its distance to the plane between the
    pivots and the least such distance of j's own rows sum to no more than the radius. An own row meets
    those j of smaller number, any other row its own cell too. With fewer rows than four cells need there is one.
    """
    k = min(own // INNER_ROWS, INNER_DISTANCES // max(1, len(x)))
    if k < 4:
        return [np.arange(own)], [np.arange(own, len(x))]
    pivots = _kmeans(x[:own], k, 2)
    k = len(pivots)
    between, half = np.maximum(np.sqrt(_squared(pivots, pivots)), 1e-9), (pivots * pivots).sum(1) / 2

    def gaps(strip):
        """The nearest pivot of each row and its distances to the planes between that and the others."""
        near = strip @ pivots.T - half
        h, each = near.argmax(1), np.arange(len(strip))
        gap = near[each, h][:, None] - near
        gap /= between[h]
        gap[each, h] = 0
        return h, gap

    strips = lambda a, z: ((s, min(s + 2048, z)) for s in range(a, z, 2048))
    home, margin = np.zeros(own, np.int64), np.full((k, k), np.inf, np.float32)
    for s, e in strips(0, own):
        home[s:e], gap = gaps(x[s:e])
        order = np.argsort(home[s:e], kind="stable")
        cells, first = np.unique(home[s:e][order], return_index=True)
        margin[cells] = np.minimum(margin[cells], np.minimum.reduceat(gap[order], first))
    rows, cols = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for s, e in [*(strips(0, own) if among else ()), *strips(own, len(x))]:
        h, gap = gaps(x[s:e])
        meets = gap + margin[:, h].T <= radius + 1e-4
        if s < own:
            meets &= np.arange(k)[None, :] < h[:, None]
        else:
            meets[np.arange(len(h)), h] = True
        r, c = np.nonzero(meets)
        rows.append((r + s).astype(np.int32))
        cols.append(c.astype(np.int32))
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    order, by_cell = np.argsort(home, kind="stable"), np.argsort(cols, kind="stable")
    first, ends = np.searchsorted(home[order], np.arange(k + 1)), np.searchsorted(cols[by_cell], np.arange(k + 1))
    return [order[first[i] : first[i + 1]] for i in range(k)], [rows[by_cell[ends[i] : ends[i + 1]]].astype(np.int64) for i in range(k)]


def _unit_pairs(x: np.ndarray, own: int, among: bool, least: float, radius: float):
    """(i, j, 0) of a unit's near pairs of the first `own` rows with those after them, and among themselves if
    asked, by inner cells; last ([], [], pairs compared)."""
    y, compared, none = x.astype(np.float32), 0, np.zeros(0, np.int64)
    for left, far in zip(*_inner(x, own, among, radius)):
        right = np.concatenate([left, far]) if among else far
        for s in range(0, len(left), 512):  # the product of a large cell in strips
            rows, cols = left[s : s + 512], right[s:] if among else right
            compared += len(rows) * len(cols)
            yield *_near_pairs(x, y, rows, cols, least), 0
    yield none, none, compared


def _link_classes(classes: DataFrame, least: float, pivots: int | None):
    """Links of distinct vectors of one length, written: class, links, to (a class it is joined with);
    rows of class -1 say in `compared` how many pairs a unit compared."""
    total = classes.count()
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
    sample = _unit(_sample(classes, "v", SAMPLE_ROWS))
    cores = _cores(sample, radius) if least > 0 else sample[:0]
    reach = _core_reach(classes, cores, radius) if len(cores) else np.zeros(0)
    free = sample if not len(cores) else sample[_squared(sample, cores).min(1) > (radius / 2) ** 2]
    free = free if len(free) else sample
    # four cells at least where there are rows for them, and as many as keep a cell small
    want = pivots or max(min(4, total // 16), min(MOST_CELLS, -(-total // CELL_ROWS)), 1)
    centres = _kmeans(free, want)
    k = len(cores)
    kind = classes.schema["v"].dataType.simpleString()
    # a function of the written vectors alone, so it may be computed as often as it is read
    cells = classes.select("class", "copies", "v").mapInArrow(_cells(cores, reach, centres, radius), f"cell int, home int, id long, copies long, v {kind}")
    at_home = F.col("cell") == F.col("home")

    # what the cores settle without comparing
    settled = None
    if k:
        places = written(cells.where(F.col("cell") < k).select("cell", "id", "copies", at_home.alias("own"), F.col("v").isNull().alias("whole")))
        core = places.groupBy("cell").agg(
            F.coalesce(F.sum(F.when(F.col("own"), F.col("copies"))), F.lit(0)).alias("weight"),
            F.min(F.when(F.col("own"), F.col("id"))).alias("rep"),
            F.coalesce(F.sum(F.when(F.col("whole"), F.col("copies"))), F.lit(0)).alias("more"),
        )
        core = F.broadcast(written(core))  # a row for each core, bounded by their number
        links = F.when(F.col("own"), F.col("weight") - F.col("copies") + F.col("more")).otherwise(F.col("weight"))
        settled = places.where("own or whole").join(core, "cell").select(F.col("id").alias("class"), links.alias("links"), F.col("rep").alias("to"))

    # a core's rows are compared only with visitors, so only where there are some
    rows = cells.where("v is not null")
    sizes = rows.groupBy("cell").agg(F.count_if(at_home).alias("own"), F.count_if(~at_home).alias("guests"))
    sizes = sizes.where((F.col("cell") >= k) | (F.col("guests") > 0))
    blocks = lambda c, n: F.greatest(F.lit(1), F.ceil(F.col(c) / n)).cast("int")
    sizes = written(sizes.select("cell", blocks("own", HOME_BLOCK).alias("homes"), blocks("guests", GUEST_BLOCK).alias("groups")))
    placed = rows.join(F.broadcast(sizes), "cell").withColumn("own", at_home)  # a row for each cell
    h = F.xxhash64("id", F.lit(5))
    placed = placed.withColumn("block", F.pmod(h, F.when(F.col("own"), F.col("homes")).otherwise(F.col("groups"))).cast("int"))
    # a home block meets every block of visitors (with, itself: in the first of them) and, but for a core's,
    # every other home block
    to = lambda n: F.sequence(F.lit(0), n - 1)
    unit = lambda lo, hi, guests: F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(guests).alias("guests"))
    b = F.col("block")
    mine = F.concat(
        F.transform(to(F.col("groups")), lambda g: unit(b, g, True)),
        F.transform(F.filter(to(F.col("homes")), lambda w: (w != b) & (F.col("cell") >= k)), lambda w: unit(F.least(b, w), F.greatest(b, w), False)),
    )
    units = placed.withColumn("u", F.explode(F.when(F.col("own"), mine).otherwise(F.transform(to(F.col("homes")), lambda w: unit(w, b, True)))))
    units = units.select("cell", "u.lo", "u.hi", "u.guests", "own", "id", "copies", "v", "block")

    def compare(key, pdf):
        cell, lo, hi, guests = key
        # two rows meet if they are of the two sides, or both of the home block in its first unit; two
        # rows at home in a core never do
        first = (pdf["own"] if guests else pdf["block"] == lo).to_numpy()
        order = np.argsort(~first, kind="stable")
        x = _unit(_rows(pdf["v"].iloc[order]))
        ids, copies = pdf["id"].to_numpy()[order], pdf["copies"].to_numpy()[order]
        links, label, pairs = np.zeros(len(x), np.int64), np.arange(len(x)), 0
        for i, j, n in _unit_pairs(x, int(first.sum()), guests and hi == 0 and cell >= k, least, radius):
            pairs += n
            links += np.bincount(i, copies[j], len(x)).astype(np.int64) + np.bincount(j, copies[i], len(x)).astype(np.int64)
            label = united(label, i, j)
        keep = np.flatnonzero(links)
        out = pd.DataFrame({"class": ids[keep], "links": links[keep], "to": ids[label[keep]], "compared": 0})
        return pd.concat([out, pd.DataFrame({"class": [-1], "links": [0], "to": [-1], "compared": [pairs]})])

    found = units.groupBy("cell", "lo", "hi", "guests").applyInPandas(compare, "class long, links long, to long, compared long")
    if settled is not None:
        found = found.unionByName(settled.withColumn("compared", F.lit(0).cast("long")))
    return written(found)


# -- nearest neighbours --------------------------------------------------------------------


class Graph:
    """The centroids with a graph of near neighbours, searched best-first in memory.

    The graph is connected: its parts are joined by their shortest edges. A search starts from
    many entries, spread over the centroids so that each is far from those before it, one in
    every part at least; groups of centroids that lie far apart are so reached directly.
    """

    def __init__(self, centres: np.ndarray, degree: int = 16):
        self.c, n = centres, len(centres)
        out = [set() for _ in range(n)]
        step = max(1, (1 << 22) // max(1, n))
        for s in range(0, n, step):
            d = _squared(centres[s : s + step], centres)
            d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
            k = min(degree, n - 1)
            near = np.argpartition(d, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(d), 0), np.int64)
            for i, r in enumerate(near, s):  # both ways, so that no centroid is out of reach of its neighbours
                for j in map(int, r):
                    out[i].add(j)
                    out[j].add(i)
        part = self._parts(out)
        firsts = np.unique(part, return_index=True)[1]
        while part.max(initial=0) > 0:  # the first part takes the one nearest to it
            a, b = np.flatnonzero(part == 0), np.flatnonzero(part)
            best = min(((d.min(), a[s + int(d.min(1).argmin())], b[int(d.min(0).argmin())]) for s in range(0, len(a), step) for d in [_squared(centres[a[s : s + step]], centres[b])]), key=lambda e: e[0])
            i, j = int(best[1]), int(best[2])
            out[i].add(j)
            out[j].add(i)
            part[part == part[j]] = 0
            part = np.unique(part, return_inverse=True)[1]
        self.near = [np.fromiter(s, np.int64, len(s)) for s in out]
        entries, far = [], np.full(n, np.inf)
        for e in [*firsts.tolist(), *([None] * max(8, n // degree))]:
            e = int(far.argmax()) if e is None else e
            if n and far[e] > 0:
                entries.append(e)
                far = np.minimum(far, _squared(centres, centres[e : e + 1])[:, 0])
        self.entries = np.array(entries, np.int64)

    @staticmethod
    def _parts(out: list[set]) -> np.ndarray:
        """The connected part of each node, numbered from 0."""
        part, n = np.full(len(out), -1), 0
        for i in range(len(out)):
            if part[i] < 0:
                todo, part[i] = [i], n
                while todo:
                    for j in out[todo.pop()]:
                        if part[j] < 0:
                            part[j] = n
                            todo.append(j)
                n += 1
        return part

    def search(self, q: np.ndarray, want: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `want` nearest centroids found, nearest first, and their distances."""
        seen = np.zeros(len(self.c), bool)
        seen[self.entries] = True
        d = np.sqrt(((self.c[self.entries] - q) ** 2).sum(1))
        todo = [(x, int(i)) for x, i in zip(d, self.entries)]
        heapq.heapify(todo)
        best = [(-x, i) for x, i in todo]
        heapq.heapify(best)
        while todo:
            x, i = heapq.heappop(todo)
            if len(best) >= width and x > -best[0][0]:
                break
            new = self.near[i][~seen[self.near[i]]]
            if len(new):
                seen[new] = True
                for y, j in zip(np.sqrt(((self.c[new] - q) ** 2).sum(1)), new):
                    if len(best) < width or y < -best[0][0]:
                        heapq.heappush(todo, (y, int(j)))
                        heapq.heappush(best, (-y, int(j)))
                        if len(best) > width:
                            heapq.heappop(best)
        found = sorted((-x, i) for x, i in best)[:want]
        return np.array([i for _, i in found], np.int64), np.array([x for x, _ in found])


def fit_centres(vectors: DataFrame, column: str, list_rows: int, sample: int = SAMPLE_ROWS) -> np.ndarray:
    """Centroids of a bounded sample, about one for list_rows vectors, MOST_CENTRES at most.

    Balanced: a centroid with over twice its share of the sample is split until none is.
    """
    total = vectors.count()
    x = _sample(vectors, column, sample)
    if not len(x):
        return np.zeros((0, 1))
    k = int(min(MOST_CENTRES, max(1, total // list_rows), len(x)))
    c = _kmeans(x, k)
    for _ in range(4):
        near = np.concatenate([_squared(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(c))
        heavy = np.flatnonzero(n > max(8, 2 * len(x) / len(c)))
        if not len(heavy) or len(c) + len(heavy) > MOST_CENTRES:
            break
        parts = [_kmeans(np.unique(x[near == h], axis=0), 2) for h in heavy]
        c = np.concatenate([c[(n > 0) & ~np.isin(np.arange(len(c)), heavy)], *parts])
    return np.unique(c, axis=0)


def posting_lists(vectors: DataFrame, centres: np.ndarray, id_col: str, vec_col: str, replicas: int = 4, slack: float = 1.1) -> DataFrame:
    """(list, id, v): every vector in its nearest centroid's list, and a boundary vector in up to
    `replicas` lists: those whose centroid is not farther than `slack` times the nearest."""

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                d = np.sqrt(_squared(_matrix(part.column(1)), centres))
                r = min(replicas, d.shape[1])
                order = np.argpartition(d, r - 1, axis=1)[:, :r]
                ok = np.take_along_axis(d, order, 1) <= slack * d.min(1)[:, None] + 1e-12
                at, col = np.nonzero(ok)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order[at, col].astype(np.int32)), part.column(0).take(take), part.column(1).take(take)], ["list", "id", "v"]
                )

    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).mapInArrow(run, "list int, id long, v array<double>")


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    id_col: str,
    vec_col: str,
    k: int = 10,
    list_rows: int = 400,
    ratio: float = 1.12,
    width: int = 96,
    salt_rows: int = 20_000,
) -> DataFrame:
    """The k nearest of vectors to each query by Euclidean distance in double precision.

    Both frames: id_col, vec_col. Returns query_id, rank, vec_id, score; ties go to the smaller
    id; a row is no neighbour of a query with its own id; rows of one
    id count once, at their smallest distance. A query asks the lists whose centroid,
    found by the graph, is at most `ratio` times as far as the nearest, and more only where
    those cannot hold k candidates; the search starts with `width` lists and widens until it has
    them all. Vectors that are null, zero, or hold null or non-finite components take no part.
    Rows with a null id are found like others, as one id that comes before any other (the least
    long is kept for it), and ask nothing. Each length of vectors has an index and neighbours of
    its own. An index is fitted to SAMPLE_ROWS vectors at most and holds every row; long
    lists are dealt over several tasks. Empty tables give no rows.
    """
    pick = lambda d: d.where(usable(F.col(vec_col))).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("v")
    )
    all_rows, asked = pick(vectors), pick(queries).where(F.col("id") != NO_ID)
    parts = sorted(r["n"] for r in all_rows.select(F.size("v").alias("n")).distinct().collect())
    schema = "query_id long, rank int, vec_id long, score double"
    if not parts:
        return all_rows.sparkSession.createDataFrame([], schema)
    got = None
    for n in parts:
        one = _candidates(*(d.where(F.size("v") == n) for d in (asked, all_rows)), n, k, list_rows, ratio, width, salt_rows)
        got = one if got is None else got.unionByName(one)
    best = got.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    top = best.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("pos", "n")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.when(F.col("n.vec_id") != NO_ID, F.col("n.vec_id")).alias("vec_id"), F.col("n.score").alias("score")
    )


def _candidates(asked: DataFrame, all_rows: DataFrame, dims: int, k: int, list_rows: int, ratio: float, width: int, salt_rows: int) -> DataFrame:
    """(query_id, vec_id, score) of the k nearest of every list asked; all vectors of one length."""
    centres = fit_centres(all_rows, "v", list_rows)
    graph = Graph(centres)
    lists = written(posting_lists(all_rows, centres, "id", "v"))
    # one row a centroid, MOST_CENTRES at most: the driver may know how many rows and ids the lists hold
    sizes = {r["list"]: r for r in lists.groupBy("list", "id").count().groupBy("list").agg(F.sum("count").alias("rows"), F.count("*").alias("ids")).collect()}
    length, distinct = (np.array([sizes[i][c] if i in sizes else 0 for i in range(len(centres))]) for c in ("rows", "ids"))

    def choose(batches):
        for b in batches:
            x, at, chosen = _matrix(b.column(1), dims), [], []
            for i, q in enumerate(x):
                want = width
                while True:
                    if want < len(centres):
                        found, d = graph.search(q, want, 2 * want)
                    else:
                        d = np.sqrt(((centres - q) ** 2).sum(1))
                        found = np.argsort(d, kind="stable")
                        d = d[found]
                    keep = max(int((d <= ratio * d[0] + 1e-12).sum()), int(np.searchsorted(np.cumsum(distinct[found]), 8 * k)) + 1)
                    if keep < len(found) or want >= len(centres):
                        break
                    want *= 4
                chosen += found[:keep].tolist()
                at += [i] * len(found[:keep])
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(chosen, pa.int32()), b.column(0).take(take), b.column(1).take(take)], ["list", "query_id", "q"])

    asks = asked.repartition(max(8, asked.sparkSession.sparkContext.defaultParallelism)).mapInArrow(choose, "list int, query_id long, q array<double>")
    salts = F.create_map(*[F.lit(int(x)) for i in range(len(centres)) for x in (i, -(-max(1, length[i]) // salt_rows))]) if length.max() > salt_rows else None
    n_salts = F.coalesce(F.element_at(salts, F.col("list")), F.lit(1)) if salts is not None else F.lit(1)
    asks = asks.withColumn("salt", F.explode(F.sequence(F.lit(0), n_salts.cast("int") - 1)))
    held = lists.withColumn("salt", F.pmod(F.xxhash64("id"), n_salts).cast("int"))

    def scan(key, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            x = x.sort_values("id", kind="stable")
            v = _rows(x["v"])
            ids, first = np.unique(x["id"].to_numpy(), return_index=True)
            for qid, w in zip(q["query_id"], q["q"]):
                d = np.minimum.reduceat(np.sqrt(((v - np.asarray(w, np.float64)) ** 2).sum(1)), first)
                d = np.where(ids == qid, np.inf, d)
                near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                near = near[np.isfinite(d[near])]
                near = near[np.lexsort((ids[near], d[near]))][:k]
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[near], "score": d[near]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64").astype({"score": "float64"})

    return asks.groupBy("list", "salt").cogroup(held.groupBy("list", "salt")).applyInPandas(scan, "query_id long, vec_id long, score double")
