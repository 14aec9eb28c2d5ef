"""The market's context at every bar, and patterns by it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context, markov
from .define import bars_sql, query
from .indicator_queries import hourly

#: The events' prices move far more than a market's, so nervous begins higher here.
_NERVOUS = 110.0
_FEATURES = ["volatility", "volatility_rank", "trend", "short_trend", "relative_volume", "momentum", "gap", "intraday", "streak", "atr", "drawdown"]
#: CTE x: symbol, i, the features and, as in `regime`, the regime.
_X = f"""{bars_sql(60)}, s AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS INT) AS i, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS prev FROM b),
 m AS (SELECT *, close / prev - 1 AS move, close > prev AS up, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr FROM s),
 c AS (SELECT *, i = 0 OR up IS DISTINCT FROM lag(up) OVER (PARTITION BY symbol ORDER BY i) AS change FROM m),
 g AS (SELECT *, max(CASE WHEN change THEN i END) OVER (PARTITION BY symbol ORDER BY i) AS began,
   CASE WHEN i >= 20 THEN sqrt(var_pop(move) OVER w20 * 252) END AS volatility,
   avg(close) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 50 PRECEDING AND 26 PRECEDING) AS old, avg(close) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING) AS new_,
   avg(close) OVER w5 AS m5, avg(close) OVER w20 AS m20, avg(volume) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS usual,
   sum(greatest(close - prev, 0)) OVER w14 AS won, sum(greatest(prev - close, 0)) OVER w14 AS lost, avg(tr) OVER w14 AS mtr, list(high) OVER w10 AS highs, list(low) OVER w10 AS lows
   FROM c WINDOW w5 AS (PARTITION BY symbol ORDER BY i ROWS 4 PRECEDING), w10 AS (PARTITION BY symbol ORDER BY i ROWS 9 PRECEDING), w14 AS (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING)),
 h AS (SELECT *, list(volatility) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 99 PRECEDING AND 20 PRECEDING) AS past FROM g),
 x AS MATERIALIZED (SELECT symbol, i, volatility, CASE WHEN i >= 100 THEN len(list_filter(past, lambda v: v < volatility)) / len(list_filter(past, lambda v: v IS NOT NULL)) END AS volatility_rank,
   CASE WHEN i >= 50 THEN (new_ - old) / old END AS trend, CASE WHEN i >= 50 THEN (m5 - m20) / m20 END AS short_trend, CASE WHEN i >= 20 AND volume > 0 AND usual > 0 THEN volume / usual END AS relative_volume,
   CASE WHEN i >= 14 THEN 100 - 100 / (1 + CASE WHEN lost > 0 THEN won / lost ELSE 100 END) END AS momentum, (open - prev) / prev * 100 AS gap, (close - open) / open * 100 AS intraday,
   CASE WHEN i >= 5 THEN least(10, i - began + 1) * CASE WHEN up THEN 1 ELSE -1 END END AS streak, CASE WHEN i >= 14 THEN mtr END AS atr,
   CASE WHEN i >= 10 THEN (list_min(lows[list_position(highs, list_max(highs)):]) - list_max(highs)) / list_max(highs) * 100 END AS drawdown,
   CASE WHEN volatility > {_NERVOUS} THEN 'HighVol' WHEN trend_ > 0.05 THEN 'Uptrend' WHEN trend_ < -0.05 THEN 'Downtrend' ELSE 'Sideways' END AS regime
   FROM (SELECT *, CASE WHEN i >= 50 THEN (new_ - old) / old ELSE 0 END AS trend_ FROM h)),
 st AS (SELECT symbol, i, CASE WHEN move > 0.003 THEN 'U' WHEN move < -0.003 THEN 'D' WHEN move IS NOT NULL THEN 'F' END AS state FROM m),
 pt AS MATERIALIZED (SELECT symbol, i, state, lag(state, 2) OVER w || lag(state) OVER w AS pattern FROM st WINDOW w AS (PARTITION BY symbol ORDER BY i))"""
#: Patterns beside the context of the bar that ends them.
_AT = "seen AS MATERIALIZED (SELECT pt.symbol, pt.i, pattern, state, x.* EXCLUDE (symbol, i) FROM pt JOIN x ON x.symbol = pt.symbol AND x.i = pt.i - 1 WHERE pattern IS NOT NULL AND state IS NOT NULL)"
_PR = """pr AS (SELECT symbol, pattern, state, n, sum(n) OVER (PARTITION BY symbol, pattern) AS total FROM (SELECT symbol, pattern, state, count(*) AS n FROM seen GROUP BY ALL)),
 cf AS MATERIALIZED (SELECT symbol, pattern, CAST(max(total) AS BIGINT) AS n, arg_max(state, (n / total, state)) AS next,
   0.5 * least(1.0, max(total) / 30) + 0.3 * (1 + sum(n / total * log2(n / total)) / log2(3)) + 0.2 * (max(n / total) - 0.33) / 0.67 AS confidence FROM pr GROUP BY symbol, pattern)"""


def _context(spark, sf_dir):
    return context.regime(context.features(hourly(spark, sf_dir)), _NERVOUS)


def _patterns(spark, sf_dir):
    """symbol, i, pattern, state and the context of the bar before."""
    s = markov.states(hourly(spark, sf_dir)).where("pattern is not null and state is not null")
    return s.join(_context(spark, sf_dir).withColumn("i", F.col("i") + 1), ["symbol", "i"])


@query(f"WITH {_X} SELECT symbol, i, regime, " + ", ".join(f"round({f}, 4) + 0.0 AS {f}" for f in _FEATURES) + " FROM x")
def market_features(spark, sf_dir):
    d = _context(spark, sf_dir)
    return d.select("symbol", F.col("i").cast("int").alias("i"), "regime", *[(F.round(F.col(f).cast("double"), 4) + 0.0).alias(f) for f in _FEATURES])


_MEANS = ["volatility", "trend", "relative_volume", "momentum", "short_trend", "volatility_rank", "streak"]


@query(f"""WITH {_X}, {_AT}, n AS (SELECT regime, pattern, state, count(*) AS n FROM seen GROUP BY ALL), a AS (SELECT regime, pattern, count(*) AS total, {", ".join(f"round(avg({m}), 3) AS {m}" for m in _MEANS)} FROM seen GROUP BY ALL)
 SELECT regime, pattern, state, n, total, round(n / total, 6) AS p, {", ".join(f"{m} + 0.0 AS {m}" for m in _MEANS)} FROM n JOIN a USING (regime, pattern)""")
def markov_regimes(spark, sf_dir):
    """What follows a pattern in each regime, and the mean context in which it was seen."""
    d = _patterns(spark, sf_dir)
    t = markov.transitions(d, ["regime"])
    means = d.groupBy("regime", "pattern").agg(*[(F.round(F.avg(m), 3) + 0.0).alias(m) for m in _MEANS])
    return t.join(means, ["regime", "pattern"]).select("regime", "pattern", "state", "n", "total", F.round("p", 6).alias("p"), *_MEANS)


@query(f"""WITH {_X}, {_AT}, {_PR} SELECT symbol, pattern, n, next, round(confidence, 6) AS confidence, CAST(k AS INT) AS place
 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(confidence, 9) DESC, n DESC, pattern) AS k FROM cf WHERE n >= 15) WHERE k <= 20""")
def markov_top_patterns(spark, sf_dir):
    """A symbol's twenty surest patterns of those seen 15 times or more."""
    c = markov.confidence(markov.transitions(_patterns(spark, sf_dir), ["symbol"]), ["symbol"])
    return markov.top(c, ["symbol"]).select("symbol", "pattern", "n", "next", F.round("confidence", 6).alias("confidence"), "place")


_STRATA = {
    "all": "true", "confidence > 0.5": "confidence > 0.5", "volatility high": f"volatility > {_NERVOUS}", "volatility low": f"volatility <= {_NERVOUS}",
    "trend up": "trend > 0.05", "trend down": "trend < -0.05", "trend flat": "abs(trend) <= 0.05", "after a streak": "abs(streak) >= 3",
}


@query(f"""WITH {_X}, {_AT}, {_PR}, j AS (SELECT seen.*, cf.confidence, CASE WHEN cf.next = seen.state THEN 1.0 ELSE 0.0 END AS hit FROM seen JOIN cf ON cf.symbol = seen.symbol AND cf.pattern = seen.pattern),
 u AS ({" UNION ALL ".join(f"SELECT '{n}' AS stratum, hit FROM j WHERE {w}" for n, w in _STRATA.items())})
 SELECT stratum, count(*) AS n, round(avg(hit), 6) AS accuracy FROM u GROUP BY stratum HAVING count(*) > 10""")
def markov_strata(spark, sf_dir):
    """How often the likeliest next state came, by confidence, volatility, trend and streak: one row a bar, dealt to its strata."""
    d = _patterns(spark, sf_dir)
    c = markov.confidence(markov.transitions(d, ["symbol"]), ["symbol"]).select("symbol", "pattern", "next", "confidence")
    d = d.join(c, ["symbol", "pattern"]).withColumn("hit", F.when(F.col("next") == F.col("state"), 1.0).otherwise(0.0))
    strata = F.array_compact(F.array(*[F.when(F.expr(w), F.lit(n)) for n, w in _STRATA.items()]))
    s = d.select(F.explode(strata).alias("stratum"), "hit").groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("accuracy"))
    return s.where("n > 10")
