"""Fourier transforms and convolutions of whole series of any length, in four steps over Spark's shuffles.

A series of n numbers is laid out as rows x cols. Every column is transformed where it stands, each
number is turned by the twiddle factor of its column and frequency, rows and columns change places
by one exchange, and every row is transformed: n log n work, and no array is longer than rows or
cols. A length with no two balanced factors (a prime, say) is a convolution with a chirp, padded to a
power of two. Keys of any share of all rows are spread over their columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A length is transformed as it is if its factors are no further apart than this; else it is padded.
BALANCE = 8


def _shape(d: DataFrame) -> DataFrame:
    """m -> rows and cols with rows x cols = m: the greatest divisor up to the root, and what it leaves."""
    root = F.floor(F.sqrt(F.col("m").cast("double"))).cast("long")
    divisors = F.filter(F.sequence(F.lit(1).cast("long"), root), lambda x: F.col("m") % x == 0)
    return d.withColumn("rows", F.array_max(divisors)).withColumn("cols", (F.col("m") / F.col("rows")).cast("long"))


def _power_of_two(least: Column) -> Column:
    """The power of two from `least` on."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.greatest(least - 1, F.lit(1).cast("long")))))


def _groups(batches, by: list[str]) -> Iterator[pa.Table]:
    """Sorted batches as tables that hold groups whole; only the last group of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    at = lambda b, i: tuple(b.column(c)[i].as_py() for c in by)
    for b in batches:
        if not b.num_rows:
            continue
        last = int(_starts(b, by)[-1])
        if last or held and at(held[-1], 0) != at(b, 0):
            if held or last:
                yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _starts(t, by: list[str]) -> np.ndarray:
    """The rows at which a group starts."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in by:
        codes = t.column(c).to_pandas().to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _values(t: pa.Table, prefix: str) -> np.ndarray:
    return t.column(f"re{prefix}").to_numpy() + 1j * t.column(f"im{prefix}").to_numpy()


def _out(t: pa.Table, at: np.ndarray, count: np.ndarray, columns: dict[str, np.ndarray], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """One row for each new number, with its group's key and shape."""
    rows = pa.array(np.repeat(at, count))
    kept = {c: t.column(c).take(rows) for c in keep}
    yield from pa.table({**kept, **{c: pa.array(v) for c, v in columns.items()}}).to_batches()


def _step(sign: int, parts: list[str], second: bool, product: bool, keep: list[str]):
    """Transform the groups of one axis: columns with their twiddle factors, or rows at the end."""
    axis, place = ("row", "col") if second else ("col", "row")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["key", axis]):
            starts = _starts(t, ["key", axis])
            ends = np.append(starts[1:], t.num_rows)
            at, line, m, rows = (t.column(c).to_numpy() for c in (place, axis, "m", "rows"))
            length = (t.column("cols") if second else t.column("rows")).to_numpy()[starts]
            values = [_values(t, p) for p in parts]
            done: list[list[np.ndarray]] = [[] for _ in parts]
            for a, b, n in zip(starts, ends, length):
                for v, out in zip(values, done):
                    x = np.zeros(n, complex)
                    np.add.at(x, at[a:b], v[a:b])
                    x = np.fft.fft(x) if sign < 0 else np.fft.ifft(x) * n
                    if not second:
                        x = x * np.exp(sign * 2j * np.pi * (np.arange(n) * int(line[a]) % int(m[a])) / int(m[a]))
                    out.append(x)
            k = np.concatenate([np.arange(n) for n in length])
            spectra = [np.concatenate(x) for x in done]
            if second and product:
                spectra = [np.prod(spectra, axis=0)]
            line, rows = np.repeat(line[starts], length), np.repeat(rows[starts], length)
            columns = {"i": line + rows * k} if second else {"row": k, "col": line}
            for p, x in zip(parts, spectra):
                columns |= {f"re{p}": x.real.copy(), f"im{p}": x.imag.copy()}
            yield from _out(t, starts, length, columns, keep)

    return run


def _four_steps(d: DataFrame, sign: int, parts: list[str], product: bool = False) -> DataFrame:
    """key, n, m, rows, cols, i and re, im of each part -> the same with i as frequency; with product,
    one part: the spectra multiplied. Numbers that are not there are 0."""
    key = d.schema["key"].dataType.simpleString()
    keep, shape = ["key", "n", "m", "rows", "cols"], f"key {key}, n long, m long, rows long, cols long"
    numbers = ", ".join(f"re{p} double, im{p} double" for p in parts)
    names = [f"{c}{p}" for p in parts for c in ("re", "im")]
    d = d.select(*keep, (F.col("i") % F.col("cols")).alias("col"), F.floor(F.col("i") / F.col("cols")).cast("long").alias("row"), *names)
    d = d.repartition("key", "col").sortWithinPartitions("key", "col")
    d = d.mapInArrow(_step(sign, parts, False, False, keep), f"{shape}, row long, col long, {numbers}")
    d = d.repartition("key", "row").sortWithinPartitions("key", "row")
    out = ["re double, im double"] if product else [numbers]
    return d.mapInArrow(_step(sign, parts, True, product, keep), f"{shape}, i long, {out[0]}")


def _turn(d: DataFrame, angle: Column) -> tuple[Column, Column]:
    """re + i im times e^(i angle)."""
    return F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle), F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)


def _chirp_angle(j: Column) -> Column:
    """pi j^2 / n, with j^2 reduced to a turn first so that no large angle loses digits."""
    return F.pi() * (j * j % (2 * F.col("n"))) / F.col("n")


def _dense(lengths: DataFrame) -> DataFrame:
    """key, n -> a row for each i below n, by two explosions of arrays no longer than the root of n."""
    side = F.ceil(F.sqrt(F.col("n").cast("double"))).cast("long")
    zero = F.lit(0).cast("long")
    d = lengths.withColumn("side", side).withColumn("a", F.explode(F.sequence(zero, F.col("side") - 1)))
    d = d.withColumn("b", F.explode(F.sequence(zero, F.col("side") - 1)))
    return d.withColumn("i", F.col("a") * F.col("side") + F.col("b")).where("i < n").drop("side", "a", "b")


def lengths_of(df: DataFrame, key: str, index: str) -> DataFrame:
    """key -> n, one more than its greatest index."""
    return df.where(F.col(index).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.max(index) + 1).cast("long").alias("n"))


def transform(df: DataFrame, key: str, index: str, re: str, im: str | None = None, inverse: bool = False) -> DataFrame:
    """The discrete Fourier transform of each key's series: key, k, re, im.

    X(k) = sum of x(j) e^(-2 pi i j k / n) over j = 0 .. n - 1, n one more than the key's greatest index;
    the inverse turns the other way and divides by n. A number that is missing or null is 0, numbers
    of one index are summed, a row without an index is left out; null keys are a series; an empty table gives no rows. Lengths with
    balanced factors take two exchanges, others four.
    """
    sign = 1 if inverse else -1
    zero = F.lit(0.0)
    d = df.where(F.col(index).isNotNull()).select(F.col(key).alias("key"), F.col(index).cast("long").alias("i"), F.coalesce(F.col(re).cast("double"), zero).alias("re"), (F.coalesce(F.col(im).cast("double"), zero) if im else zero).alias("im"))
    n = lengths_of(df, key, index)
    plan = _shape(n.withColumn("m", F.col("n"))).withColumn("whole", F.col("cols") <= BALANCE * F.col("rows"))
    k = d["key"]
    joined = lambda p: d.join(p.withColumnRenamed("key", "key_"), k.eqNullSafe(F.col("key_"))).drop("key_")
    direct = _four_steps(joined(plan.where("whole").drop("whole")), sign, [""])

    # x(j) w(j), convolved with 1 / w, times w, where w(j) = e^(sign i pi j^2 / n)
    odd = _shape(plan.where("not whole").select("key", "n", _power_of_two(2 * F.col("n") - 1).alias("m")))
    a_re, a_im = _turn(d, sign * _chirp_angle(F.col("i")))
    a = joined(odd).select("key", "n", "m", "rows", "cols", "i", a_re.alias("re"), a_im.alias("im"), zero.alias("re2"), zero.alias("im2"))
    angle = -sign * _chirp_angle(F.col("i"))
    back = F.when(F.col("i") == 0, F.array(F.col("i"))).otherwise(F.array(F.col("i"), F.col("m") - F.col("i")))
    b = _dense(odd).select("key", "n", "m", "rows", "cols", F.explode(back).alias("j"), F.cos(angle).alias("re2"), F.sin(angle).alias("im2"))
    b = b.select("key", "n", "m", "rows", "cols", F.col("j").alias("i"), zero.alias("re"), zero.alias("im"), "re2", "im2")
    both = _four_steps(_four_steps(a.unionByName(b), -1, ["", "2"], product=True), 1, [""]).where("i < n")
    both = both.withColumns({"re": F.col("re") / F.col("m"), "im": F.col("im") / F.col("m")})
    c_re, c_im = _turn(both, sign * _chirp_angle(F.col("i")))
    chirped = both.select("key", "n", "i", c_re.alias("re"), c_im.alias("im"))
    out = direct.select("key", "n", "i", "re", "im").unionByName(chirped)
    by = F.col("n") if inverse else F.lit(1.0)
    return out.select(F.col("key").alias(key), F.col("i").alias("k"), (F.col("re") / by).alias("re"), (F.col("im") / by).alias("im"))


def convolve(a: DataFrame, b: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """Each key's series of a convolved with that of b: key, index, value.

    y(k) = sum of a(j) b(k - j), for k up to the sum of both greatest indexes; a key that only one
    side has gives nothing. Missing and null numbers are 0. Both transforms go through the same two
    exchanges and are multiplied where they end; two more go back.
    """
    na, nb = lengths_of(a, key, index), lengths_of(b, key, index).withColumnsRenamed({"key": "key_", "n": "n_"})
    plan = na.join(nb, na["key"].eqNullSafe(nb["key_"])).select("key", (F.col("n") + F.col("n_") - 1).alias("n"))
    plan = _shape(plan.withColumn("m", _power_of_two(F.col("n")))).withColumnRenamed("key", "key_")
    zero = F.lit(0.0)

    def side(d: DataFrame, first: bool) -> DataFrame:
        v = F.coalesce(F.col(value).cast("double"), zero)
        d = d.where(F.col(index).isNotNull()).select(F.col(key).alias("key"), F.col(index).cast("long").alias("i"), (v if first else zero).alias("re"), zero.alias("im"), (zero if first else v).alias("re2"), zero.alias("im2"))
        return d.join(plan, d["key"].eqNullSafe(F.col("key_"))).drop("key_")

    both = side(a, True).unionByName(side(b, False))
    y = _four_steps(_four_steps(both, -1, ["", "2"], product=True), 1, [""]).where("i < n")
    return y.select(F.col("key").alias(key), F.col("i").alias(index), (F.col("re") / F.col("m")).alias(value))


def autocorrelation(df: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """key, lag, value: the sum of x(t) x(t + lag) over a key's whole series, for every lag from 0."""
    n = lengths_of(df, key, index).withColumnsRenamed({"key": "key_", "n": "n_"})
    x = df.select(F.col(key), F.col(index).cast("long").alias(index), value)
    turned = x.join(n, x[key].eqNullSafe(F.col("key_"))).select(key, (F.col("n_") - 1 - F.col(index)).alias(index), value)
    y = convolve(x, turned, key, index, value).join(n, F.col(key).eqNullSafe(F.col("key_")))
    return y.where(F.col(index) >= F.col("n_") - 1).select(key, (F.col(index) - F.col("n_") + 1).alias("lag"), value)
