import numpy as np
import pyarrow as pa
import pytest

from tidemark.operators import spectrum


def series(spark, data, columns="k string, i long, x double, y double"):
    rows = [(k, i, float(v.real), float(v.imag)) for k, xs in data.items() for i, v in enumerate(np.asarray(xs, complex))]
    return spark.createDataFrame(rows, columns).repartition(5)


def arrays(df, key, index, *values):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], {})[r[index]] = tuple(r[v] for v in values)
    assert all(sorted(x) == list(range(len(x))) for x in out.values())
    return {k: np.array([x[i] for i in range(len(x))]) for k, x in out.items()}


def test_transform_of_any_length(spark):
    rng = np.random.default_rng(1)
    data = {str(n): rng.normal(size=n) + 1j * rng.normal(size=n) for n in (1, 2, 3, 7, 12, 64, 97, 360, 1009, 2 * 509)}
    data[None] = rng.normal(size=30)
    there = spectrum.transform(series(spark, data, "sym string, i long, x double, y double"), "sym", "i", "x", "y")
    got = arrays(there, "sym", "k", "re", "im")
    assert set(got) == set(data)
    for k, x in data.items():
        assert np.allclose(got[k][:, 0] + 1j * got[k][:, 1], np.fft.fft(x), atol=1e-9)


def test_inverse_gives_the_series_back(spark):
    rng = np.random.default_rng(2)
    data = {"a": rng.normal(size=101), "b": rng.normal(size=120)}
    d = series(spark, data, "sym string, i long, x double, y double")
    there = spectrum.transform(d, "sym", "i", "x")
    back = arrays(spectrum.transform(there, "sym", "k", "re", "im", inverse=True), "sym", "k", "re", "im")
    for k, x in data.items():
        assert np.allclose(back[k][:, 0], x) and np.allclose(back[k][:, 1], 0)


def test_convolution_and_autocorrelation(spark):
    rng = np.random.default_rng(3)
    data, other = {"a": rng.normal(size=50), "b": rng.normal(size=7), "c": [1.0]}, {"a": rng.normal(size=9), "b": rng.normal(size=33)}
    s = "sym string, i long, x double, y double"
    a, b = series(spark, data, s), series(spark, other, s)
    got = arrays(spectrum.convolve(a, b, "sym", "i", "x"), "sym", "i", "x")
    assert set(got) == {"a", "b"}
    for k in got:
        assert np.allclose(got[k][:, 0], np.convolve(data[k], other[k]))
    auto = arrays(spectrum.autocorrelation(a, "sym", "i", "x"), "sym", "lag", "x")
    for k, x in data.items():
        x = np.asarray(x)
        assert np.allclose(auto[k][:, 0], [np.dot(x[: len(x) - h], x[h:]) for h in range(len(x))])


def test_gaps_nulls_repeats_and_empty_tables(spark):
    d = spark.createDataFrame([("a", 0, 1.0), ("a", 4, None), ("a", 2, 2.0), ("a", 2, 0.5), ("a", None, 9.0)], "sym string, i long, x double")
    got = arrays(spectrum.transform(d, "sym", "i", "x"), "sym", "k", "re", "im")["a"]
    assert np.allclose(got[:, 0] + 1j * got[:, 1], np.fft.fft([1, 0, 2.5, 0, 0]))
    assert spectrum.transform(d.where("false"), "sym", "i", "x").count() == 0
    assert spectrum.autocorrelation(d.where("false"), "sym", "i", "x").count() == 0


@pytest.mark.parametrize("cuts", [[1, 2, 5], [3, 3, 4], [10], [2, 6]])
def test_groups_stay_whole_over_batches(cuts):
    keys = ["a", "a", "a", "b", "c", "c", "c", "c", "c", "d"]
    t = pa.table({"key": keys, "v": range(10)})
    at, batches = 0, []
    for n in [*cuts, 10]:
        batches += t.slice(at, n).to_batches()
        at += n
    got = [x.column("key").to_pylist() for x in spectrum._groups(batches, ["key"])]
    assert sum(got, []) == keys
    for a, b in zip(got, got[1:]):
        assert a[-1] != b[0]


def test_no_array_beyond_the_root(spark):
    """The layout of a long series: both sides stay near the root of its (padded) length."""
    d = spark.createDataFrame([(n,) for n in (2880, 1 << 20, 1000003, 999983 * 2)], "n long")
    m = d.select(spectrum.F.when(d.n > 1000000, spectrum._power_of_two(2 * d.n - 1)).otherwise(d.n).alias("m"))
    for r in spectrum._shape(m).collect():
        assert r.rows * r.cols == r.m and r["cols"] <= 2 * r["m"] ** 0.5
