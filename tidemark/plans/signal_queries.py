"""Spectra and correlations of whole series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spectrum
from .define import bars_sql, query
from .indicator_queries import hourly

_S = "s AS MATERIALIZED (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM b)"


@query(f"""WITH {bars_sql(15)}, {_S}, f AS (SELECT DISTINCT symbol, i AS k FROM s)
 SELECT symbol, f.k, round(sum(close * cos(2 * pi() * ((f.k * i) % n) / n)) + 0.0, 3) + 0.0 AS re, round(-sum(close * sin(2 * pi() * ((f.k * i) % n) / n)) + 0.0, 3) + 0.0 AS im FROM s JOIN f USING (symbol) GROUP BY symbol, f.k""")
def fourier_spectrum(spark, sf_dir):
    """The transform of every symbol's full series of quarter-hour closes, whatever its length."""
    x = spectrum.transform(hourly(spark, sf_dir, 15), "symbol", "i", "close")
    return x.select("symbol", "k", (F.round("re", 3) + 0.0).alias("re"), (F.round("im", 3) + 0.0).alias("im"))


@query(f"""WITH {bars_sql(60)}, {_S}, m AS (SELECT symbol, i, close - avg(close) OVER (PARTITION BY symbol) AS x FROM s)
 SELECT a.symbol, b.i - a.i AS lag, round(sum(a.x * b.x), 3) + 0.0 AS value FROM m a JOIN m b ON a.symbol = b.symbol AND b.i >= a.i GROUP BY a.symbol, b.i - a.i""")
def autocorrelation(spark, sf_dir):
    """Products of a symbol's hourly closes about their mean, summed for every lag: a convolution, not a join."""
    h = hourly(spark, sf_dir).select("symbol", "i", "close")
    mean = h.groupBy("symbol").agg(F.avg("close").alias("mean"))
    x = h.join(mean, "symbol").select("symbol", "i", (F.col("close") - F.col("mean")).alias("value"))
    return spectrum.autocorrelation(x, "symbol", "i", "value").select("symbol", "lag", (F.round("value", 3) + 0.0).alias("value"))
