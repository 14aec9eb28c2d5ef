"""Trades and their scores, insider studies, options, Markov patterns, arrays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import backtest, insider, markov, risk
from ..operators.indicators import catalogue, compute
from ..session import table
from .define import bars_sql, query
from .indicator_queries import hourly
from .series_sql import student_sql

_B = f"""{bars_sql(60)}, s AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS INT) AS i FROM b),
 v AS (SELECT symbol, i, close, CASE WHEN i >= 13 THEN avg(close) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) ELSE 0.0 END AS sma FROM s),
 d0 AS (SELECT *, nullif(sign(sma - lag(sma) OVER (PARTITION BY symbol ORDER BY i)), 0) AS nz FROM v),
 d1 AS (SELECT *, count(nz) OVER (PARTITION BY symbol ORDER BY i) AS k FROM d0),
 d2 AS (SELECT *, max(nz) OVER (PARTITION BY symbol, k) AS held FROM d1),
 d3 AS MATERIALIZED (SELECT symbol, i, close, CASE WHEN nz IS NOT NULL AND nz IS DISTINCT FROM lag(held) OVER (PARTITION BY symbol ORDER BY i) THEN nz ELSE 0 END AS delta FROM d2),
 e AS (SELECT symbol, max(i) AS i, arg_max(close, i) AS close FROM d3 GROUP BY symbol),
 x AS (SELECT *, lead(i) OVER w AS ni, lead(close) OVER w AS nc FROM d3 WHERE delta <> 0 WINDOW w AS (PARTITION BY symbol ORDER BY i)),
 tr AS MATERIALIZED (SELECT x.symbol, x.i AS open_i, coalesce(ni, e.i) AS close_i, CAST(delta AS INT) AS side, x.close AS open_price, coalesce(nc, e.close) AS close_price
   FROM x JOIN e USING (symbol) WHERE coalesce(ni, e.i) > x.i),
 g AS MATERIALIZED (SELECT *, CASE WHEN open_price <> 0 THEN (close_price / open_price - 1) * side ELSE 0.0 END * 100 AS gain FROM tr)"""


def _deltas(spark, sf_dir):
    return backtest.switches(compute(hourly(spark, sf_dir), catalogue()["sma"], keep=("close",)), "sma")


def _trades(spark, sf_dir):
    return backtest.trades(_deltas(spark, sf_dir))


@query(f"WITH {_B} SELECT symbol, i, CAST(delta AS INT) AS delta FROM d3")
def switch_deltas(spark, sf_dir):
    return _deltas(spark, sf_dir).select("symbol", "i", F.col("delta").cast("int").alias("delta"))


@query(f"WITH {_B} SELECT symbol, open_i, close_i, side, round(open_price, 6) AS open_price, round(close_price, 6) AS close_price FROM tr")
def delta_trades(spark, sf_dir):
    return _trades(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("open_price", "close_price")})


@query(f"""WITH {_B}, c AS (SELECT *, max(CASE WHEN gain <= -100 THEN 1 ELSE 0 END) OVER w AS flat, exp(sum(ln(1 + greatest(gain, -99.999999) / 100)) OVER w) * 100000 AS bal
   FROM g WINDOW w AS (PARTITION BY symbol ORDER BY open_i))
 SELECT symbol, open_i, round(gain, 6) AS gain, round(CASE WHEN flat = 1 THEN 0.0 ELSE bal END, 2) AS balance FROM c""")
def trade_balances(spark, sf_dir):
    d = backtest.balances(_trades(spark, sf_dir))
    return d.select("symbol", "open_i", F.round("gain", 6).alias("gain"), F.round("balance", 2).alias("balance"))


_R = "CASE WHEN {b} = 0 THEN {o} ELSE {a} / {b} END"
_EDGE = "CASE WHEN {} > 0 THEN CAST('inf' AS DOUBLE) ELSE 0.0 END"


@query(f"""WITH {_B}, a AS (SELECT symbol, count(*) AS trades, avg(gain / 100) AS m, stddev_pop(gain / 100) AS sd,
   coalesce(sqrt(avg((gain / 100) * (gain / 100)) FILTER (gain < 0)), 0.0) AS dn, coalesce(sum(gain / 100) FILTER (gain > 0), 0.0) AS won, -coalesce(sum(gain / 100) FILTER (gain < 0), 0.0) AS lost,
   count(*) FILTER (gain > 0) AS nw, count(*) FILTER (gain < 0) AS nl FROM g GROUP BY symbol),
 w AS (SELECT *, {_R.format(a='won', b='nw', o='0.0')} AS aw, {_R.format(a='lost', b='nl', o='0.0')} AS al FROM a)
 SELECT symbol, trades, round({_R.format(a='m', b='sd', o=_EDGE.format('m'))}, 6) AS sharpe, round({_R.format(a='m', b='dn', o=_EDGE.format('m'))}, 6) AS sortino, round(nw / trades, 6) AS win_rate,
  round({_R.format(a='aw', b='al', o=_EDGE.format('aw'))}, 6) AS win_loss, round({_R.format(a='won', b='lost', o=_EDGE.format('won'))}, 6) AS profit_factor FROM w""")
def risk_metrics(spark, sf_dir):
    t = backtest.balances(_trades(spark, sf_dir))
    m = risk.metrics(t, "symbol")
    return m.select("symbol", "trades", *[F.round(c, 6).alias(c) for c in m.columns[2:]])


@query(f"""WITH {bars_sql(60)}, p AS (SELECT symbol, close, max(close) OVER (PARTITION BY symbol ORDER BY ts) AS peak FROM b)
 SELECT symbol, round(max((peak - close) / peak), 6) AS max_drawdown FROM p GROUP BY symbol""")
def max_drawdown(spark, sf_dir):
    return risk.max_drawdown(hourly(spark, sf_dir), "symbol", "ts", "close").withColumn("max_drawdown", F.round("max_drawdown", 6))


@query(f"""WITH {bars_sql(1440)}, a AS (SELECT symbol, arg_min(close, ts) AS first, arg_max(close, ts) AS last, date_diff('day', min(ts), max(ts)) AS days FROM b GROUP BY symbol)
 SELECT symbol, round(first, 6) AS first, round(last, 6) AS last, CAST(days AS INT) AS days, round(pow(last / first, 1 / greatest(days / 365.25, 1 / 252)) - 1, 4) AS cagr FROM a""")
def compound_growth(spark, sf_dir):
    g = risk.growth(hourly(spark, sf_dir, 1440), "symbol", "ts", "close")
    return g.select("symbol", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), "days", F.round("cagr", 4).alias("cagr"))


@query(f"""WITH {bars_sql(1440)}, r AS (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM b)
 SELECT symbol, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe_annual, round(stddev_samp(r) * sqrt(252), 6) AS volatility FROM r GROUP BY symbol""")
def daily_returns(spark, sf_dir):
    b = hourly(spark, sf_dir, 1440)
    r = b.select("symbol", (F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("ts")) - 1).alias("r"))
    root = F.sqrt(F.lit(252.0))
    return r.groupBy("symbol").agg(F.round(F.avg("r") / F.stddev_samp("r") * root, 6).alias("sharpe_annual"), F.round(F.stddev_samp("r") * root, 6).alias("volatility"))


@query(f"""WITH {bars_sql(1440)}, r AS (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM b),
 a AS (SELECT symbol, count(r) AS n, avg(r) AS mean, avg(r) / (stddev_samp(r) / sqrt(count(r))) AS t, count(r) - 1 AS df FROM r GROUP BY symbol)
 SELECT symbol, n, round(mean, 6) AS mean, round(t, 6) AS t, df, round(1 - {student_sql("t", "df")}, 8) AS p FROM a""")
def returns_t_test(spark, sf_dir):
    b = hourly(spark, sf_dir, 1440)
    r = b.select("symbol", (F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("ts")) - 1).alias("r"))
    return risk.t_test(r, "symbol", "r").select("symbol", "n", F.round("mean", 6).alias("mean"), F.round("t", 6).alias("t"), "df", F.round("p", 8).alias("p"))


#: CTEs s (bars with i) and w: the windows of each symbol's own number of bars, 252 to train and 63 to test.
_WINDOWS = f"""{bars_sql(60)}, s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM b),
 w AS (SELECT symbol AS sy, CAST(a // 63 AS INT) AS window_, a, a + 252 AS z, a + 315 AS c FROM (SELECT symbol, unnest(range(0, count(*) - 314, 63)) AS a FROM s GROUP BY symbol)),
 j AS (SELECT symbol, window_, CASE WHEN i < z THEN 'train' ELSE 'test' END AS part, close, i FROM s JOIN w ON sy = symbol AND i >= a AND i < c)"""


@query(f"""WITH {_WINDOWS},
 p AS (SELECT symbol, window_, part, arg_max(close, i) / arg_min(close, i) - 1 AS perf FROM j GROUP BY ALL)
 SELECT symbol, count(*) FILTER (part = 'test') AS windows, round(median(perf) FILTER (part = 'test'), 6) AS med, round(avg(perf) FILTER (part = 'test'), 6) AS mean,
  round(avg(perf) FILTER (part = 'train') - avg(perf) FILTER (part = 'test'), 6) AS gap,
  round(0.5 * median(perf) FILTER (part = 'test') + 0.2 * avg(perf) FILTER (part = 'test') + 0.1 * avg(CASE WHEN perf > 0 THEN 1.0 ELSE 0.0 END) FILTER (part = 'test')
   + 0.2 * least(0.0, min(perf) FILTER (part = 'test')) - 0.3 * greatest(0.0, avg(perf) FILTER (part = 'train') - avg(perf) FILTER (part = 'test')), 6) AS score FROM p GROUP BY symbol""")
def walk_forward_score(spark, sf_dir):
    """The composite over the windows of all bars of a symbol."""
    return _walk_forward_score(backtest.in_all_windows(hourly(spark, sf_dir), 252, 63, 63))


def _walk_forward_score(d):
    p = d.groupBy("symbol", "window", "part").agg((F.max_by("close", "i") / F.min_by("close", "i") - 1).alias("perf"))
    test = F.when(F.col("part") == "test", F.col("perf"))
    gap = F.avg(F.when(F.col("part") == "train", F.col("perf"))) - F.avg(test)
    passed = F.avg(F.when(F.col("part") == "test", F.when(F.col("perf") > 0, 1.0).otherwise(0.0)))
    score = 0.5 * F.median(test) + 0.2 * F.avg(test) + 0.1 * passed + 0.2 * F.least(F.lit(0.0), F.min(test)) - 0.3 * F.greatest(F.lit(0.0), gap)
    r = lambda x, n: F.round(x, 6).alias(n)
    return p.groupBy("symbol").agg(F.count(test).alias("windows"), r(F.median(test), "med"), r(F.avg(test), "mean"), r(gap, "gap"), r(score, "score"))


@query(f"""WITH {bars_sql(60)}, s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM b), m AS (SELECT symbol AS sy, count(*) AS n, count(*) // 6 AS size FROM s GROUP BY symbol),
 w AS (SELECT sy, CAST(k AS INT) AS fold, size * (k + 1) AS te, size * (k + 1) + 5 AS ts_, least(n, size * (k + 1) + 5 + size // 2) AS tz FROM m, (SELECT unnest(range(0, 5)) AS k)),
 p AS (SELECT symbol, fold, avg(close) FILTER (i < te) AS train, avg(close) FILTER (i >= ts_ AND i < tz) AS test FROM s JOIN w ON sy = symbol GROUP BY symbol, fold)
 SELECT symbol, fold, round(train, 6) AS train, round(test, 6) AS test FROM p""")
def purged_folds(spark, sf_dir):
    """Means of expanding training parts and the purged tests behind them, by each symbol's own number of bars."""
    d = hourly(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("symbol"))).withColumn("size", F.expr("n div 6"))
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("end", F.col("size") * (F.col("fold") + 1))
    i, start = F.col("i"), F.col("end") + 5
    tested = (i >= start) & (i < F.least("n", start + F.expr("size div 2")))
    mean = lambda c, n: F.round(F.avg(F.when(c, F.col("close"))), 6).alias(n)
    return d.groupBy("symbol", "fold").agg(mean(i < F.col("end"), "train"), mean(tested, "test"))


@query("""WITH a AS (SELECT event_id, [sign(value - 20), sign(user_id % 3 - 1), sign(event_id % 5 - 2)] AS s FROM events)
 SELECT event_id, CAST(list_sum(s) AS INT) AS total, CAST(sign(list_sum(s)) AS INT) AS majority, CAST(CASE WHEN s[1] = s[2] AND s[2] = s[3] THEN s[1] ELSE 0 END AS INT) AS consensus,
  CAST(round(s[1] * 0.5 + s[2] * 0.25 + s[3] * 0.75, 0) AS INT) AS weighted FROM a""")
def signal_combination(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = F.array(F.signum(F.col("value") - 20), F.signum((F.col("user_id") % 3 - 1).cast("double")), F.signum((F.col("event_id") % 5 - 2).cast("double")))
    e = e.select("event_id", s.alias("s"))
    c = lambda how, n, w=None: backtest.combine(F.col("s"), how, w).cast("int").alias(n)
    return e.select("event_id", c("sum", "total"), c("majority", "majority"), c("consensus", "consensus"), c("weighted", "weighted", [0.5, 0.25, 0.75]))


# -- insider transactions, on orders and customers -----------------------------------------

_ROLES = {"1-URGENT": "CEO", "2-HIGH": "CFO", "3-MEDIUM": "Director", "4-NOT SPECIFIED": "Board", "5-LOW": "COO"}
_ROLE_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ROLES.items()) + " END"
_WEIGHT_SQL = "CASE role " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.ROLE_WEIGHTS.items()) + " ELSE 1.0 END"
_T = f"""o AS (SELECT o_orderkey AS id, o_custkey AS owner, CASE WHEN o_custkey % 17 = 0 THEN 'BRK.B' WHEN o_custkey % 19 = 0 THEN '' ELSE 'T' || (o_custkey % 40) END AS ticker,
   CASE o_orderstatus WHEN 'F' THEN 'P' WHEN 'O' THEN 'S' ELSE 'A' END AS code, o_totalprice AS price, 1.0 AS shares, o_orderdate AS day, {_ROLE_SQL} AS role, o_orderkey % 11 = 0 AS plan FROM orders),
 sig AS (SELECT *, shares * price AS value FROM o WHERE ticker <> '' AND position('.' IN ticker) = 0 AND NOT plan AND code = 'P' AND shares * price >= 250000),
 ws AS (SELECT *, {_WEIGHT_SQL} AS weight FROM sig)"""


def _transactions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    role = F.element_at(F.create_map(*[F.lit(x) for kv in _ROLES.items() for x in kv]), F.col("o_orderpriority"))
    key = F.col("o_custkey")
    ticker = F.when(key % 17 == 0, "BRK.B").when(key % 19 == 0, "").otherwise(F.concat(F.lit("T"), (key % 40).cast("string")))
    code = F.when(F.col("o_orderstatus") == "F", "P").when(F.col("o_orderstatus") == "O", "S").otherwise("A")
    return o.select(
        F.col("o_orderkey").alias("id"), key.alias("owner"), ticker.alias("ticker"), code.alias("code"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("shares"),
        F.to_date("o_orderdate").alias("day"), role.alias("role"), (F.col("o_orderkey") % 11 == 0).alias("plan"), F.lit("").alias("security"), F.lit(True).alias("is_officer"), F.lit(False).alias("is_director"),
    )


def _signals(spark, sf_dir):
    return insider.signals(_transactions(spark, sf_dir)).withColumn("weight", S.role_weight(F.col("role")))


@query(f"WITH {_T} SELECT id, ticker, role, round(value, 2) AS value, CAST(weight AS DOUBLE) AS weight FROM ws")
def insider_signals(spark, sf_dir):
    return _signals(spark, sf_dir).select("id", "ticker", "role", F.round("value", 2).alias("value"), "weight")


@query(f"WITH {_T} SELECT CAST(CAST(day AS DATE) AS VARCHAR) AS day, count(*) AS n, round(sum(value), 2) AS value FROM ws GROUP BY day")
def signals_by_day(spark, sf_dir):
    return _signals(spark, sf_dir).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query(f"""WITH {_T}, a AS (SELECT ticker, count(DISTINCT owner) AS insiders, sum(weight) AS weight, sum(value) AS value FROM ws GROUP BY ticker),
 c AS (SELECT *, log10(greatest(value, 1.0)) - 5 + weight / 4 + (insiders - 1) / 2 AS score FROM a)
 SELECT ticker, insiders, round(CAST(weight AS DOUBLE), 4) AS weight, round(value, 2) AS value, round(CAST(score AS DOUBLE), 6) AS score, CASE WHEN score >= 5 THEN 'A+' WHEN score >= 3.5 THEN 'A' WHEN score >= 1 THEN 'B' ELSE 'C' END AS tier FROM c""")
def cluster_tiers(spark, sf_dir):
    c = insider.clusters(_signals(spark, sf_dir))
    return c.select("ticker", "insiders", F.round("weight", 4).alias("weight"), F.round("value", 2).alias("value"), F.round("score", 6).alias("score"), "tier")


@query(f"WITH {_T} SELECT role, count(*) AS n, round(sum(value), 2) AS value, round(avg(value), 2) AS mean FROM ws GROUP BY role")
def value_by_role(spark, sf_dir):
    return _signals(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"), F.round(F.avg("value"), 2).alias("mean"))


# -- Markov --------------------------------------------------------------------------------

_M = f"""{bars_sql(60)}, s AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS INT) AS i FROM b),
 r AS (SELECT symbol, i, close / lag(close) OVER (PARTITION BY symbol ORDER BY i) - 1 AS ret FROM s),
 st AS (SELECT *, CASE WHEN ret > 0.003 THEN 'U' WHEN ret < -0.003 THEN 'D' WHEN ret IS NOT NULL THEN 'F' END AS state FROM r),
 pt AS MATERIALIZED (SELECT symbol, i, state, lag(state, 2) OVER w || lag(state) OVER w AS pattern FROM st WINDOW w AS (PARTITION BY symbol ORDER BY i)),
 tr AS (SELECT symbol, pattern, state, count(*) AS n FROM pt WHERE pattern IS NOT NULL AND state IS NOT NULL GROUP BY ALL),
 sh AS (SELECT *, CAST(sum(n) OVER (PARTITION BY symbol, pattern) AS BIGINT) AS total FROM tr), pr AS (SELECT *, n / total AS p FROM sh)"""


@query(f"WITH {_M} SELECT symbol, pattern, state, n, total, round(p, 6) AS p FROM pr")
def markov_transitions(spark, sf_dir):
    return markov.transitions(markov.states(hourly(spark, sf_dir)), ["symbol"]).select("symbol", "pattern", "state", "n", "total", F.round("p", 6).alias("p"))


@query(f"""WITH {_M} SELECT symbol, pattern, max(total) AS n, arg_max(state, (p, state)) AS next,
  round(0.5 * least(1.0, max(total) / 30) + 0.3 * (1 + sum(p * log2(p)) / log2(3)) + 0.2 * (max(p) - 0.33) / 0.67, 6) AS confidence FROM pr GROUP BY symbol, pattern""")
def markov_confidence(spark, sf_dir):
    c = markov.confidence(markov.transitions(markov.states(hourly(spark, sf_dir)), ["symbol"]), ["symbol"])
    return c.select("symbol", "pattern", "n", "next", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {_M}, own AS (SELECT symbol, pattern, arg_max(state, (p, state)) AS next, max(total) AS n FROM pr GROUP BY symbol, pattern),
 ag AS (SELECT pattern, state, sum(n) AS n FROM tr GROUP BY ALL), com AS (SELECT pattern, arg_max(state, (n, state)) AS next FROM ag GROUP BY pattern)
 SELECT pt.symbol, i, pt.pattern, coalesce(own.next, com.next, 'F') AS predicted FROM pt LEFT JOIN own ON own.symbol = pt.symbol AND own.pattern = pt.pattern AND own.n >= 15
  LEFT JOIN com ON com.pattern = pt.pattern WHERE pt.pattern IS NOT NULL""")
def markov_prediction(spark, sf_dir):
    s = markov.states(hourly(spark, sf_dir))
    own = markov.confidence(markov.transitions(s, ["symbol"]), ["symbol"])
    every = markov.confidence(markov.transitions(s, []), [])
    return markov.predict(s, own, every)


@query(f"""WITH {_M}, blk AS (SELECT DISTINCT symbol, i // 63 AS block FROM pt),
 seen AS (SELECT blk.symbol, block, pattern, state, count(*) AS n FROM blk JOIN pt ON pt.symbol = blk.symbol AND pt.i < block * 63 AND pattern IS NOT NULL AND state IS NOT NULL GROUP BY ALL),
 own AS (SELECT symbol, block, pattern, arg_max(state, (n, state)) AS next, sum(n) AS n, max(n) / sum(n) AS pmax FROM seen GROUP BY symbol, block, pattern HAVING sum(n) >= 15),
 x AS (SELECT pt.symbol, pt.i, r.ret, CASE WHEN own.next = 'D' THEN 0 WHEN own.next = 'U' THEN 2 + CASE WHEN own.pmax > 0.5 THEN 1 ELSE 0 END + CASE WHEN own.n >= 100 THEN 1 ELSE 0 END ELSE 1 END AS k
   FROM pt JOIN r USING (symbol, i) LEFT JOIN own ON own.symbol = pt.symbol AND own.pattern = pt.pattern AND own.block = pt.i // 63 WHERE pt.pattern IS NOT NULL AND r.ret IS NOT NULL)
 SELECT symbol, count(*) AS bars, round(avg(0.9 + 0.1 * k), 6) AS exposure, round(sum(ln(greatest(1 + ret * (0.9 + 0.1 * k), 1e-6))), 4) AS log_growth FROM x GROUP BY symbol""")
def markov_rebalance(spark, sf_dir):
    """Exposure 0.9 + 0.1 k on every bar: k is 0 for a fall, 1 without a signal, 2 to 4 for a confident rise.

    A block of 63 bars is traded by what the bars before it showed: counts of each block are summed up over the
    blocks before, so nothing is fitted on the bars that it trades.
    """
    s = markov.states(hourly(spark, sf_dir)).withColumn("block", F.floor(F.col("i") / 63))
    known = markov.known_before(s, "block")
    own = markov.confidence(known, ["symbol", "block"]).where("n >= 15").select("symbol", "block", "pattern", "next", "n", "pmax")
    d = s.where("pattern is not null and ret is not null").join(own, ["symbol", "block", "pattern"], "left")
    up = F.lit(2) + F.when(F.col("pmax") > 0.5, 1).otherwise(0) + F.when(F.col("n") >= 100, 1).otherwise(0)
    k = F.when(F.col("next") == "D", 0).when(F.col("next") == "U", up).otherwise(1)
    e = 0.9 + 0.1 * k
    return d.groupBy("symbol").agg(F.count("*").alias("bars"), F.round(F.avg(e), 6).alias("exposure"), F.round(F.sum(F.ln(F.greatest(1 + F.col("ret") * e, F.lit(1e-6)))), 4).alias("log_growth"))


# -- options and scalars -------------------------------------------------------------------

_CDF = "(CASE WHEN {x} > 8 THEN 1.0 WHEN {x} < -8 THEN 0.0 ELSE CASE WHEN {x} >= 0 THEN 1 - {t} ELSE {t} END END)"


def _cdf_sql(x: str) -> str:
    k = f"(1 / (1 + 0.2316419::DOUBLE * abs({x})))"
    t = f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {k} * (0.319381530::DOUBLE + {k} * (-0.356563782::DOUBLE + {k} * (1.781477937::DOUBLE + {k} * (-1.821255978::DOUBLE + {k} * 1.330274429::DOUBLE)))))"
    return _CDF.format(x=f"({x})", t=t)


_OPT = """q AS (SELECT p_partkey, p_retailprice AS s, p_retailprice * (0.8 + (p_partkey % 41) / 100.0) AS k, (p_size + 1) / 52.0 AS t, 0.1 + (p_partkey % 30) / 100.0 AS v, p_partkey % 2 = 0 AS call FROM part),
 z AS (SELECT *, (ln(s / k) + (0.05 + v * v / 2) * t) / (v * sqrt(t)) AS d1, (ln(s / k) + (0.05 + v * v / 2) * t) / (v * sqrt(t)) - v * sqrt(t) AS d2 FROM q)"""


def _options(spark, sf_dir):
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    s = F.col("p_retailprice")
    return p.select("p_partkey", s.alias("s"), (s * (0.8 + (key % 41) / 100.0)).alias("k"), ((F.col("p_size") + 1) / 52.0).alias("t"), (0.1 + (key % 30) / 100.0).alias("v"), (key % 2 == 0).alias("call"))


@query(f"""WITH {_OPT} SELECT p_partkey, round(CASE WHEN call THEN s * {_cdf_sql('d1')} - k * exp(-0.05 * t) * {_cdf_sql('d2')}
  ELSE k * exp(-0.05 * t) * {_cdf_sql('-d2')} - s * {_cdf_sql('-d1')} END, 4) AS price FROM z""")
def black_scholes_price(spark, sf_dir):
    c, z = F.col, F.lit
    price = S.black_scholes(c("s"), c("k"), c("t"), z(0.05), z(0.0), c("v"), c("call"))
    return _options(spark, sf_dir).select("p_partkey", F.round(price, 4).alias("price"))


@query(f"WITH {_OPT} SELECT p_partkey, round(v, 3) AS sigma FROM q WHERE k / s BETWEEN 0.9 AND 1.1 AND t > 0.2")
def implied_volatility_round_trip(spark, sf_dir):
    c, z = F.col, F.lit
    d = _options(spark, sf_dir).where("k / s BETWEEN 0.9 AND 1.1 AND t > 0.2")
    d = d.withColumn("price", S.black_scholes(c("s"), c("k"), c("t"), z(0.05), z(0.0), c("v"), c("call")))
    iv = S.implied_volatility(c("price"), c("s"), c("k"), c("t"), z(0.05), z(0.0), c("call"), rounds=40)
    return d.select("p_partkey", F.round(iv, 3).alias("sigma"))


@query("""WITH q AS (SELECT p_partkey, 'ROOT' || (p_partkey % 7) AS root, CAST('2024-01-01' AS DATE) + CAST(p_partkey % 700 AS INT) AS day, CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END AS kind, p_size * 5.5 AS strike FROM part)
 SELECT p_partkey, root, CAST(day AS VARCHAR) AS expiration, kind, CAST(strike AS DOUBLE) AS strike, 'O:' || root || strftime(day, '%y%m%d') || kind || lpad(CAST(CAST(round(strike * 1000) AS BIGINT) AS VARCHAR), 8, '0') AS symbol FROM q""")
def option_symbols(spark, sf_dir):
    key = F.col("p_partkey")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (key % 700).cast("int"))
    sym = S.occ_symbol(F.concat(F.lit("ROOT"), (key % 7).cast("string")), day, F.when(key % 2 == 0, "C").otherwise("P"), F.col("p_size") * 5.5)
    d = table(spark, sf_dir, "part").select("p_partkey", sym.alias("symbol"))
    d = d.withColumn("o", S.occ(F.col("symbol")))
    return d.select("p_partkey", "o.root", F.col("o.expiration").cast("string").alias("expiration"), "o.kind", "o.strike", "symbol")


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
 SELECT CAST(day AS VARCHAR) AS day, CAST(CAST(date_trunc('month', day) AS DATE) + CAST((12 - isodow(date_trunc('month', day))) % 7 + 14 AS INT) AS VARCHAR) AS third_friday,
  CAST(day + CASE isodow(day) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS VARCHAR) AS next_day, CAST(quarter(day) AS INT) AS quarter FROM d""")
def calendar_dates(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return d.select(
        F.col("day").cast("string").alias("day"), S.third_friday(F.col("day")).cast("string").alias("third_friday"), S.next_trading_day(F.col("day")).cast("string").alias("next_day"), F.quarter("day").alias("quarter")
    )


@query("""SELECT o_orderkey, CAST(round_even(o_totalprice / 7, 2) AS DOUBLE) AS money, CASE o_orderstatus WHEN 'F' THEN 'Tax' WHEN 'P' THEN 'Purchase' ELSE 'Unknown' END AS label FROM orders""")
def money_and_codes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.money(F.col("o_totalprice") / 7).alias("money"), S.code_label(F.col("o_orderstatus")).alias("label"))


# -- ranking, arrays, matrices -------------------------------------------------------------


@query("""WITH r AS (SELECT c_custkey, c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS q FROM customer)
 SELECT c_nationkey, c_custkey, CAST(k AS INT) AS k, CAST(q AS INT) AS quarter FROM r WHERE k <= 5""")
def top_of_group(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.row_number().over(w).alias("k"), F.ntile(4).over(w).alias("quarter"))
    return c.where("k <= 5")


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total, round(list_min(embedding)::DOUBLE, 6) AS least, round(list_max(embedding)::DOUBLE, 6) AS most, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings")
def array_aggregates(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
        F.round(F.array_min(e), 6).alias("least"),
        F.round(F.array_max(e), 6).alias("most"),
        F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"),
    )


@query("""WITH e AS (SELECT label, unnest(range(0, 64)) AS j, unnest(embedding::DOUBLE[]) AS x FROM embeddings), m AS (SELECT label, j, sum(x) AS x FROM e GROUP BY ALL)
 SELECT a.label AS i, b.label AS j, round(sum(a.x * b.x), 3) AS v FROM m a JOIN m b USING (j) GROUP BY a.label, b.label""".replace("a.label AS i, b.label AS j, round", "a.label AS r, b.label AS c, round"))
def matrix_product(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("j", "x"))
    m = e.groupBy("label", "j").agg(F.sum(F.col("x").cast("double")).alias("x"))
    b = m.select(F.col("label").alias("c"), "j", F.col("x").alias("y"))
    return m.join(b, "j").groupBy(F.col("label").alias("r"), "c").agg(F.round(F.sum(F.col("x") * F.col("y")), 3).alias("v"))


@query(f"""WITH {bars_sql(60)}, s AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM b), x AS (SELECT symbol, close, i // 64 AS block, i % 64 AS j FROM s), f AS (SELECT unnest(range(0, 33)) AS k)
 SELECT symbol, block, k, round(sqrt(pow(sum(close * cos(2 * pi() * k * j / 64)), 2) + pow(sum(close * sin(2 * pi() * k * j / 64)), 2)), 4) AS magnitude FROM x, f GROUP BY symbol, block, k""")
def fourier_magnitudes(spark, sf_dir):
    """The spectrum of every consecutive block of 64 bars, so that all bars enter; the last block is filled with zeros."""
    x = hourly(spark, sf_dir).select("symbol", "close", F.expr("i div 64").alias("block"), (F.col("i") % 64).alias("j"))
    x = x.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(32).cast("long"))))
    a = 2 * 3.141592653589793 * F.col("k") * F.col("j") / 64
    part = lambda f: F.pow(F.sum(F.col("close") * f(a)), F.lit(2.0))
    return x.groupBy("symbol", "block", "k").agg(F.round(F.sqrt(part(F.cos) + part(F.sin)), 4).alias("magnitude"))


@query("""SELECT (SELECT count(*) FROM events) AS n, round(sum(value), 4) AS total, round(var_pop(value), 4) AS variance FROM events""")
def reduction(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.var_pop("value"), 4).alias("variance"))
