"""Contracts, completeness, contexts, configurations, tests and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..operators import backtest, bars as B
from ..session import table
from .bar_queries import _bars
from .define import TICKS, bars_sql, query, stamp
from .indicator_queries import hourly
from .series_sql import gamma_sql
from .study_queries import _B, _trades


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def integrity_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


_C = """c AS MATERIALIZED (SELECT l_orderkey AS id, 'T' || (l_suppkey % 5) AS root, CAST(l_shipdate AS DATE) AS day, l_shipdate AS ts, CASE WHEN l_linenumber % 2 = 0 THEN 'C' ELSE 'P' END AS kind,
  90.0 + l_partkey % 21 AS strike, l_extendedprice / (l_quantity * 100) AS price, 5 + CAST(l_tax * 1000 AS INT) AS dte, CAST(l_quantity AS BIGINT) AS volume, l_linenumber AS n FROM lineitem)"""


def _contracts(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        F.col("l_orderkey").alias("id"),
        F.concat(F.lit("T"), (F.col("l_suppkey") % 5).cast("string")).alias("root"),
        F.to_date("l_shipdate").alias("day"),
        F.col("l_shipdate").alias("ts"),
        F.when(F.col("l_linenumber") % 2 == 0, "C").otherwise("P").alias("kind"),
        (F.lit(90.0) + F.col("l_partkey") % 21).alias("strike"),
        (F.col("l_extendedprice") / (F.col("l_quantity") * 100)).alias("price"),
        (5 + F.rint(F.col("l_tax") * 1000).cast("int")).alias("dte"),
        F.col("l_quantity").cast("long").alias("volume"),
        F.col("l_linenumber").alias("n"),
    )


@query(f"""WITH {_C} SELECT root, kind, strike, count(*) AS rows_, count(DISTINCT day) AS days, CAST(sum(volume) AS BIGINT) AS volume FROM c GROUP BY ALL""")
def contract_index(spark, sf_dir):
    """What an index of byte ranges reports, from the rows themselves."""
    return _contracts(spark, sf_dir).groupBy("root", "kind", "strike").agg(F.count("*").alias("rows_"), F.countDistinct("day").alias("days"), F.sum("volume").alias("volume"))


@query(f"""WITH {_C} SELECT root, CAST(day AS VARCHAR) AS day, count(*) AS records, CAST(sum(volume) AS BIGINT) AS volume, max(price) AS high, min(price) AS low,
  arg_min(price, (id, n, price)) AS open, arg_max(price, (id, n, price)) AS close, list_sort(list_distinct(list(kind)))[1] AS first_kind FROM c GROUP BY root, day""")
def daily_contract_summary(spark, sf_dir):
    order = F.struct("id", "n", "price")
    r = lambda x, a: x.alias(a)
    return _contracts(spark, sf_dir).groupBy("root", F.col("day").cast("string").alias("day")).agg(
        F.count("*").alias("records"), F.sum("volume").alias("volume"), r(F.max("price"), "high"), r(F.min("price"), "low"),
        r(F.min_by("price", order), "open"), r(F.max_by("price", order), "close"), F.get(F.sort_array(F.collect_set("kind")), F.lit(0)).alias("first_kind"),
    )


@query(f"""WITH {_C}, u AS (SELECT root, day, avg(strike) AS underlying FROM c GROUP BY ALL)
 SELECT c.root, count(*) AS kept FROM c JOIN u USING (root, day) WHERE abs(strike - underlying) <= 7 AND dte BETWEEN 0 AND 45 GROUP BY c.root""")
def option_proximity(spark, sf_dir):
    c = _contracts(spark, sf_dir)
    u = c.groupBy("root", "day").agg(F.avg("strike").alias("underlying"))
    d = c.join(u, ["root", "day"]).where((F.abs(F.col("strike") - F.col("underlying")) <= 7) & F.col("dte").between(0, 45))
    return d.groupBy("root").agg(F.count("*").alias("kept"))


@query(f"""WITH {_C} SELECT id, n, CASE WHEN price < 0.05 THEN 'tiny' WHEN price > 100 THEN 'above underlying' WHEN abs(strike - 100) > 20 AND dte < 7 AND price > 0.5 THEN 'far and dear'
  WHEN abs(strike - 100) <= 2 AND dte >= 7 AND price < 0.5 THEN 'near and cheap' ELSE 'ok' END AS verdict FROM c""")
def option_price_sanity(spark, sf_dir):
    far, p, t = F.abs(F.col("strike") - 100), F.col("price"), F.col("dte")
    v = F.when(p < 0.05, "tiny").when(p > 100, "above underlying").when((far > 20) & (t < 7) & (p > 0.5), "far and dear").when((far <= 2) & (t >= 7) & (p < 0.5), "near and cheap")
    return _contracts(spark, sf_dir).select("id", "n", v.otherwise("ok").alias("verdict"))


@query(f"""WITH {_C}, r AS (SELECT id, n, root, kind, strike, row_number() OVER (PARTITION BY root, kind ORDER BY abs(strike - 101), abs(dte - 40), id, n) AS k FROM c)
 SELECT root, kind, id, n, CAST(strike AS DOUBLE) AS strike FROM r WHERE k <= 3""")
def chain_selection(spark, sf_dir):
    w = Window.partitionBy("root", "kind").orderBy(F.abs(F.col("strike") - 101), F.abs(F.col("dte") - 40), "id", "n")
    return _contracts(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 3").select("root", "kind", "id", "n", "strike")


@query(f"""WITH {_C} SELECT id, n, row_number() OVER (ORDER BY root NULLS FIRST, kind, day NULLS FIRST, strike NULLS FIRST, id NULLS FIRST, n NULLS FIRST) AS pos FROM c""")
def contract_order(spark, sf_dir):
    """The place of every contract in the order of root, calls before puts, expiry and strike.

    Rows are counted by cell (root, kind, day); the cells before a row's own and its place inside
    make its position, so no task sorts the table."""
    c, cell = _contracts(spark, sf_dir), ["root", "kind", "day"]
    counts = c.groupBy(*cell).agg(F.count("*").alias("rows_"))
    before = lambda w: F.coalesce(F.sum("rows_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("root", "kind").agg(F.sum("rows_").alias("rows_"))
    groups = groups.select(F.col("root").alias("r"), F.col("kind").alias("k"), before(Window.orderBy("root", "kind")).alias("ahead"))
    cells = counts.withColumn("earlier", before(Window.partitionBy("root", "kind").orderBy("day")))
    cells = cells.join(F.broadcast(groups), F.col("root").eqNullSafe(F.col("r")) & F.col("kind").eqNullSafe(F.col("k")))
    cells = cells.select("r", "k", F.col("day").alias("d"), (F.col("ahead") + F.col("earlier")).alias("start"))
    same = F.col("root").eqNullSafe(F.col("r")) & F.col("kind").eqNullSafe(F.col("k")) & F.col("day").eqNullSafe(F.col("d"))
    own = F.row_number().over(Window.partitionBy(*cell).orderBy("strike", "id", "n"))
    return c.withColumn("own", own).join(cells, same).select("id", "n", (F.col("start") + F.col("own")).alias("pos"))


@query(f"""WITH {_C}, e AS (SELECT root, count(DISTINCT (kind, strike, day)) AS expected FROM c GROUP BY root), a AS (SELECT root, count(DISTINCT (kind, strike, day)) AS actual FROM c WHERE n <= 5 GROUP BY root)
 SELECT root, expected, actual, expected - actual AS missing FROM e JOIN a USING (root) WHERE expected > actual ORDER BY missing DESC, root LIMIT 5""")
def completeness_report(spark, sf_dir):
    c = _contracts(spark, sf_dir)
    n = lambda d, a: d.select("root", "kind", "strike", "day").distinct().groupBy("root").agg(F.count("*").alias(a))
    d = n(c, "expected").join(n(c.where("n <= 5"), "actual"), "root").withColumn("missing", F.col("expected") - F.col("actual"))
    return d.where("missing > 0").orderBy(F.col("missing").desc(), "root").limit(5)


@query(f"""WITH {bars_sql(60)}, w AS (SELECT symbol, ts, ts = min(ts) OVER p AS first_of_day, ts = max(ts) OVER p AS last_of_day FROM b WINDOW p AS (PARTITION BY symbol, CAST(ts AS DATE)))
 SELECT symbol, {stamp()} AS ts, first_of_day, last_of_day, ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20 12:30:00' AS complete FROM w""")
def bar_of_day_flags(spark, sf_dir):
    """Completeness is judged at a given time, never by the clock."""
    p = Window.partitionBy("symbol", F.to_date("ts"))
    b = _bars(spark, sf_dir, 60)
    done = F.col("ts") + F.expr("interval 1 hour") <= F.lit("2024-01-20 12:30:00").cast("timestamp_ntz")
    return b.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), (F.col("ts") == F.min("ts").over(p)).alias("first_of_day"), (F.col("ts") == F.max("ts").over(p)).alias("last_of_day"), done.alias("complete"))


@query(f"""WITH {bars_sql(1440, 'd')}, {bars_sql(60)[len(TICKS) + 1:].strip()},
 h AS (SELECT symbol, CAST(ts AS DATE) AS day, arg_min(open, ts) AS o, arg_max(close, ts) AS c, max(high) AS hi, min(low) AS lo FROM b GROUP BY ALL)
 SELECT d.symbol, CAST(CAST(d.ts AS DATE) AS VARCHAR) AS day, abs(open - o) < 1e-6 AND abs(close - c) < 1e-6 AND abs(high - hi) < 1e-6 AND abs(low - lo) < 1e-6 AS consistent
 FROM d JOIN h ON h.symbol = d.symbol AND h.day = CAST(d.ts AS DATE)""")
def daily_against_hourly(spark, sf_dir):
    d, h = _bars(spark, sf_dir, 1440), B.resample(_bars(spark, sf_dir, 60), 1440)
    h = h.select("symbol", "ts", *[F.col(c).alias(f"h_{c}") for c in ("open", "high", "low", "close")])
    same = F.lit(True)
    for c in ("open", "high", "low", "close"):
        same = same & (F.abs(F.col(c) - F.col(f"h_{c}")) < 1e-6)
    return d.join(h, ["symbol", "ts"]).select("symbol", F.to_date("ts").cast("string").alias("day"), same.alias("consistent"))


@query(f"""WITH {bars_sql(60)}, s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos FROM b)
 SELECT a.pos, round(a.close / c.close, 6) AS relative FROM s a JOIN s c USING (pos) WHERE a.symbol = 'view' AND c.symbol = 'click'""")
def positional_zip(spark, sf_dir):
    s = hourly(spark, sf_dir)
    a = s.where("symbol = 'view'").select("i", "close")
    c = s.where("symbol = 'click'").select("i", F.col("close").alias("other"))
    return a.join(c, "i").select((F.col("i") + 1).cast("long").alias("pos"), F.round(F.col("close") / F.col("other"), 6).alias("relative"))


@query(f"""WITH {bars_sql(60)}, s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS lr FROM b),
 f AS (SELECT symbol, i, avg(volume) OVER w AS vol20, stddev_samp(lr) OVER w * sqrt(252) AS sigma, close / lag(close, 10) OVER o - 1 AS mom, volume / avg(volume) OVER w AS rel, max(close) OVER w10 AS peak, close
   FROM s WINDOW o AS (PARTITION BY symbol ORDER BY i), w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w10 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
 SELECT symbol, CAST(i AS INT) AS i, round(vol20, 6) AS vol20, round(sigma, 6) AS sigma, round(mom, 6) AS momentum, round(rel, 6) AS relative_volume, round((peak - close) / peak, 6) AS drawdown10 FROM f WHERE i >= 20""")
def market_context(spark, sf_dir):
    o = Window.partitionBy("symbol").orderBy("i")
    w, w10 = o.rowsBetween(-19, 0), o.rowsBetween(-9, 0)
    d = hourly(spark, sf_dir).withColumn("lr", F.ln(F.col("close") / F.lag("close").over(o)))
    r = lambda x, a: F.round(x, 6).alias(a)
    peak = F.max("close").over(w10)
    d = d.select(
        "symbol", "i", r(F.avg("volume").over(w), "vol20"), r(F.stddev_samp("lr").over(w) * F.sqrt(F.lit(252.0)), "sigma"), r(F.col("close") / F.lag("close", 10).over(o) - 1, "momentum"),
        r(F.col("volume") / F.avg("volume").over(w), "relative_volume"), r((peak - F.col("close")) / peak, "drawdown10"),
    )
    return d.where("i >= 20")


@query(f"""WITH {bars_sql(60)}, s AS (SELECT symbol, close, ts, ln(greatest(1.0, lead(close) OVER w / close)) AS up, min(close) OVER w AS lo FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts))
 SELECT symbol, round(sum(up), 4) AS log_perfect, round(max(close / lo), 6) AS best_long FROM s GROUP BY symbol""")
def perfect_foresight(spark, sf_dir):
    """Long on every rise, as a sum of logarithms; and the best single buy and sale."""
    o = Window.partitionBy("symbol").orderBy("i")
    d = hourly(spark, sf_dir).select("symbol", "close", F.ln(F.greatest(F.lit(1.0), F.lead("close").over(o) / F.col("close"))).alias("up"), F.min("close").over(o).alias("lo"))
    return d.groupBy("symbol").agg(F.round(F.sum("up"), 4).alias("log_perfect"), F.round(F.max(F.col("close") / F.col("lo")), 6).alias("best_long"))


@query(f"""WITH {bars_sql(60)}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) / count(*) OVER (PARTITION BY symbol) AS share FROM b)
 SELECT symbol, CASE WHEN share <= 0.6 THEN 'train' WHEN share <= 0.8 THEN 'validation' ELSE 'test' END AS part, count(*) AS n, round(avg(close), 6) AS mean FROM r GROUP BY ALL""")
def chronological_split(spark, sf_dir):
    d = hourly(spark, sf_dir).withColumn("share", (F.col("i") + 1) / F.count("*").over(Window.partitionBy("symbol")))
    part = F.when(F.col("share") <= 0.6, "train").when(F.col("share") <= 0.8, "validation").otherwise("test")
    return d.groupBy("symbol", part.alias("part")).agg(F.count("*").alias("n"), F.round(F.avg("close"), 6).alias("mean"))


@query(f"""WITH {bars_sql(15)}, s AS MATERIALIZED (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM b), n AS (SELECT symbol, count(*) AS n FROM s GROUP BY symbol),
 a AS (SELECT unnest([252, 378, 504, 630, 756, 1008]) AS train), r AS (SELECT unnest([10, 15, 20, 25, 33]) AS ratio), p AS (SELECT unnest([1, 2, 3, 4, 5]) AS part),
 c AS (SELECT DISTINCT train, train * ratio // 100 AS test, greatest(1, train * ratio // 100 // part) AS step FROM a, r, p),
 w AS (SELECT symbol, train, test, step, unnest(generate_series(0, n - train - test, step)) AS start FROM c, n WHERE n >= train + test),
 g AS (SELECT w.*, z.close / y.close - 1 AS ret FROM w JOIN s y ON y.symbol = w.symbol AND y.i = start + train JOIN s z ON z.symbol = w.symbol AND z.i = start + train + test - 1)
 SELECT symbol, CAST(train AS INT) AS train, CAST(test AS INT) AS test, CAST(step AS INT) AS step, count(*) AS windows, round(avg(ret), 3) + 0.0 AS mean, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS won FROM g GROUP BY ALL""")
def window_configurations(spark, sf_dir):
    """Every different triple of the generator's lengths on every symbol's quarter-hour bars: how many windows fit, and how their tests ran."""
    s = hourly(spark, sf_dir, 15).select("symbol", F.col("i").cast("long").alias("i"), "close")
    w = backtest.configured_windows(s.groupBy("symbol").agg(F.count("*").alias("n")))
    at = lambda name: s.withColumnsRenamed({"i": f"i_{name}", "close": name})
    w = w.withColumns({"i_first": F.col("start") + F.col("train"), "i_last": F.col("start") + F.col("train") + F.col("test") - 1})
    g = w.join(at("first"), ["symbol", "i_first"]).join(at("last"), ["symbol", "i_last"]).withColumn("ret", F.col("last") / F.col("first") - 1)
    return g.groupBy("symbol", "train", "test", "step").agg(F.count("*").alias("windows"), (F.round(F.avg("ret"), 3) + 0.0).alias("mean"), F.round(F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)), 6).alias("won"))


@query(f"""WITH {_B}, h AS (SELECT symbol, gain > 0 AS hit, CASE WHEN close_i - open_i > 2 THEN 'long' ELSE 'short' END AS stratum, side FROM g)
 SELECT symbol, stratum, CAST(side AS VARCHAR) AS side, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM h GROUP BY GROUPING SETS ((symbol), (stratum), (side), ()) HAVING count(*) > 10""")
def stratified_accuracy(spark, sf_dir):
    t = backtest.balances(_trades(spark, sf_dir))
    d = t.select("symbol", F.when(F.col("gain") > 0, 1.0).otherwise(0.0).alias("hit"), F.when(F.col("close_i") - F.col("open_i") > 2, "long").otherwise("short").alias("stratum"), "side")
    cols = [F.col("symbol"), F.col("stratum"), F.col("side")]
    s = d.groupingSets([[cols[0]], [cols[1]], [cols[2]], []], *cols).agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("accuracy"))
    return s.where("n > 10").withColumn("side", F.col("side").cast("string"))


@query(f"""WITH {_B}, h AS (SELECT symbol, count(*) AS n, avg(CASE WHEN gain > 0 THEN 1.0 ELSE 0.0 END) AS acc FROM g GROUP BY symbol),
 z AS (SELECT *, (acc - 1 / 3) / sqrt((2 / 9) / n) AS z FROM h)
 SELECT symbol, n, round(acc, 6) AS accuracy, round(z, 4) AS z, round(1 - {gamma_sql("0.5", "z * z / 2")}, 8) AS p FROM z""")
def proportion_z_test(spark, sf_dir):
    t = backtest.balances(_trades(spark, sf_dir))
    d = t.groupBy("symbol").agg(F.count("*").alias("n"), F.avg(F.when(F.col("gain") > 0, 1.0).otherwise(0.0)).alias("acc"))
    z = (F.col("acc") - 1 / 3) / F.sqrt(F.lit(2 / 9) / F.col("n"))
    p = 2 * D.survival("normal", F.abs(z), 0.0, 1.0)
    return d.select("symbol", "n", F.round("acc", 6).alias("accuracy"), F.round(z, 4).alias("z"), F.round(p, 8).alias("p"))


@query(f"""WITH {_B}, a AS (SELECT symbol, count(*) AS trades, avg(close_i - open_i) AS duration, sum(gain) AS total FROM g GROUP BY symbol)
 SELECT symbol, trades, round(duration, 6) AS duration, trades >= 10 AND duration >= 2 AS selected, round(total, 4) AS total FROM a""")
def selection_gates(spark, sf_dir):
    t = backtest.balances(_trades(spark, sf_dir))
    d = t.groupBy("symbol").agg(F.count("*").alias("trades"), F.avg(F.col("close_i") - F.col("open_i")).alias("duration"), F.round(F.sum("gain"), 4).alias("total"))
    return d.select("symbol", "trades", F.round("duration", 6).alias("duration"), ((F.col("trades") >= 10) & (F.col("duration") >= 2)).alias("selected"), "total")


@query(f"""WITH {_B}, l AS (SELECT symbol, arg_max(close, i) AS close, avg(close) AS mean, stddev_pop(close) AS sd FROM d3 GROUP BY symbol), z AS (SELECT symbol, (close - mean) / sd AS z FROM l)
 SELECT symbol, round(z, 6) AS z, CASE WHEN z > 0.5 THEN 'BUY' WHEN z < -0.5 THEN 'SELL' ELSE 'HOLD' END AS signal, round(least(1.0, abs(z) / 2), 6) AS confidence FROM z""")
def current_signal(spark, sf_dir):
    d = hourly(spark, sf_dir).groupBy("symbol").agg(((F.max_by("close", "i") - F.avg("close")) / F.stddev_pop("close")).alias("z"))
    s = F.when(F.col("z") > 0.5, "BUY").when(F.col("z") < -0.5, "SELL").otherwise("HOLD")
    return d.select("symbol", F.round("z", 6).alias("z"), s.alias("signal"), F.round(F.least(F.lit(1.0), F.abs("z") / 2), 6).alias("confidence"))


@query("""WITH g AS (SELECT o_custkey AS id, list_sort(list_distinct(list(o_orderpriority))) AS genes FROM orders GROUP BY o_custkey), k AS (SELECT array_to_string(genes, '|') AS pattern, id FROM g)
 SELECT pattern, count(*) AS n, count(*) <= 2 AS rare FROM k GROUP BY pattern""")
def schema_frequency(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), "|").alias("pattern"))
    return g.groupBy("pattern").agg(F.count("*").alias("n"), (F.count("*") <= 2).alias("rare"))


@query("""WITH e AS (SELECT DISTINCT s_nationkey AS id, CAST(s_acctbal // 500 AS INT) AS gene FROM supplier), n AS (SELECT id, count(*) AS n FROM e GROUP BY id),
 c AS (SELECT a.id AS a, b.id AS b, count(*) AS both_ FROM e a JOIN e b ON a.gene = b.gene AND a.id < b.id GROUP BY ALL)
 SELECT a, b, round(both_ / (x.n + y.n - both_), 6) AS similarity FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b""".replace("CAST(s_acctbal // 500 AS INT)", "CAST(floor(s_acctbal / 500) AS INT)"))
def genome_similarity(spark, sf_dir):
    """Pairs meet on what they share, not in a cross product."""
    e = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id"), F.floor(F.col("s_acctbal") / 500).cast("int").alias("gene")).distinct()
    n = e.groupBy("id").agg(F.count("*").alias("n"))
    c = e.select(F.col("id").alias("a"), "gene").join(e.select(F.col("id").alias("b"), "gene"), "gene").where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    c = c.join(n.select(F.col("id").alias("a"), F.col("n").alias("x")), "a").join(n.select(F.col("id").alias("b"), F.col("n").alias("y")), "b")
    return c.select("a", "b", F.round(F.col("k") / (F.col("x") + F.col("y") - F.col("k")), 6).alias("similarity"))


@query("""SELECT event_id, round(exp(-pow((value - 30) / 15, 2) / 2) / (15 * sqrt(2 * pi())), 8) AS normal_pdf, round(1 - exp(-value / 30), 8) AS exponential_cdf,
  round(greatest(0.0, least((value - 10) / 20, (50 - value) / 20, 1.0)), 6) AS triangular, round(1 / (1 + exp(-(value - 30) / 5)), 8) AS sigmoid FROM events""")
def distributions_and_membership(spark, sf_dir):
    v = F.col("value")
    z = (v - 30) / 15
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.round(F.exp(-F.pow(z, F.lit(2.0)) / 2) / (15 * F.sqrt(2 * F.pi())), 8).alias("normal_pdf"),
        F.round(1 - F.exp(-v / 30), 8).alias("exponential_cdf"),
        F.round(F.greatest(F.lit(0.0), F.least((v - 10) / 20, (50 - v) / 20, F.lit(1.0))), 6).alias("triangular"),
        F.round(1 / (1 + F.exp(-(v - 30) / 5)), 8).alias("sigmoid"),
    )


@query("SELECT event_type AS symbol, round(corr(value, user_id), 6) AS correlation, round(skewness(value), 4) AS skew_, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def moments(spark, sf_dir):
    n = F.count("value")
    adjust = F.sqrt(n * (n - 1)) / (n - 2)
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol")).agg(
        F.round(F.corr("value", "user_id"), 6).alias("correlation"), F.round(F.skewness("value") * adjust, 4).alias("skew_"), F.round(F.expr("percentile(value, 0.9)"), 6).alias("p90")
    )
