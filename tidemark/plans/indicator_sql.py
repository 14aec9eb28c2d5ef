"""What each indicator is, in SQL of its own: rules stated over rows, lists of the last rows and walks from row to row.

Nothing here is made from the operators' steps, so that a query and its SQL can disagree.
"""

from __future__ import annotations

from .define import bars_sql


def last(x: str, n: int, fn: str = "avg") -> str:
    """fn over the list of the last n values."""
    return f"list_{fn}(list({x}) OVER (PARTITION BY symbol ORDER BY i ROWS {n - 1} PRECEDING))"


def ago(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY i)"


def so_far(x: str, fn: str = "sum") -> str:
    return f"{fn}({x}) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)"


def walk(name: str, src: str, first: str, then: str) -> str:
    """CTE name (symbol, i, y): y is `first` on row 0 of src and `then`, of r.y before and q's row, after."""
    return (
        f"{name} AS (SELECT symbol, i, CAST({first} AS DOUBLE) AS y FROM {src} WHERE i = 0 UNION ALL "
        f"SELECT q.symbol, q.i, CAST({then} AS DOUBLE) FROM {name} r JOIN {src} q ON q.symbol = r.symbol AND q.i = r.i + 1)"
    )


def ema(name: str, src: str, x: str, n: int) -> str:
    """Moves a part 2 / (n + 1) of the way to each new value."""
    return walk(name, src, x, f"r.y + (q.{x} - r.y) * 2.0 / {n + 1}")


def meet(*names: str) -> str:
    """FROM s joined with walks, whose y becomes the walk's name."""
    return "(SELECT s.*, " + ", ".join(f"{n}.y AS {n}" for n in names) + " FROM s " + " ".join(f"JOIN {n} ON {n}.symbol = s.symbol AND {n}.i = s.i" for n in names) + ")"


def seeded(name: str, src: str, x: str, n: int, weight: float, start: int = 0) -> list[str]:
    """From the plain mean of the n values that end at n - 1 + start; 0 before."""
    at = n - 1 + start
    return [
        f"{name}0 AS MATERIALIZED (SELECT symbol, i, {x}, {last(x, n)} AS m FROM {src})",
        walk(name, f"{name}0", f"CASE WHEN {at} = 0 THEN m ELSE 0 END", f"CASE WHEN q.i < {at} THEN 0 WHEN q.i = {at} THEN q.m ELSE r.y + (q.{x} - r.y) * {weight!r} END"),
    ]


N = 14
TR = "CASE WHEN i = 0 THEN 0 ELSE greatest(h, pc) - least(l, pc) END"
_P = f"p AS MATERIALIZED (SELECT *, {ago('o')} AS po, {ago('h')} AS ph, {ago('l')} AS pl, {ago('c')} AS pc FROM s)"
_AO = f"ao AS (SELECT *, CASE WHEN i >= 33 THEN {last('(h + l) / 2', 5)} - {last('(h + l) / 2', 34)} ELSE 0 END AS a FROM s)"
_AC = f"{_AO}, ac AS (SELECT *, CASE WHEN i >= 37 THEN a - {last('a', 5)} ELSE 0 END AS k FROM ao)"
_AD = f"w AS MATERIALIZED (SELECT *, {so_far('CASE WHEN h <> l THEN ((c - l) - (h - c)) * v / (h - l) ELSE 0 END')} AS y FROM s)"
_MACD = [ema("f", "s", "c", 12), ema("g", "s", "c", 26), "m AS MATERIALIZED (SELECT f.symbol, f.i, f.y - g.y AS d FROM f JOIN g ON g.symbol = f.symbol AND g.i = f.i)", ema("sig", "m", "d", 9)]
_MOVES = f"""{_P}, d AS MATERIALIZED (SELECT symbol, i, CASE WHEN up > dn THEN up ELSE 0 END AS pdm, CASE WHEN dn > up THEN dn ELSE 0 END AS ndm, tr FROM (
   SELECT symbol, i, CASE WHEN i > 0 AND h > ph THEN h - ph ELSE 0 END AS up, CASE WHEN i > 0 AND pl > l THEN pl - l ELSE 0 END AS dn,
     CASE WHEN i > 0 THEN greatest(h - l, abs(h - pc), abs(l - pc)) ELSE 0 END AS tr FROM p))"""
_DX = "CASE WHEN a + b <> 0 THEN 100 * abs(a - b) / (a + b) ELSE 0 END"


def zero_smoothed(name: str, src: str, x: str, n: int = N) -> str:
    """From 0; rows before n leave it there."""
    return walk(name, src, "0", f"CASE WHEN q.i >= {n} THEN (r.y * {n - 1} + q.{x}) / {n}.0 ELSE 0 END")


def _smoothed(name: str, n: int) -> list[str]:
    return seeded(name, "md", "x", n, 1 / n)


_MD = "md AS MATERIALIZED (SELECT symbol, i, (h + l) / 2 AS x FROM s)"
_LIPS = [_MD, *_smoothed("jw", 13), *_smoothed("th", 8), *_smoothed("lp", 5)]
_BODY = "(SELECT s.symbol, s.i, jw.y AS jw, th.y AS th, lp.y AS lp FROM s JOIN jw ON jw.symbol = s.symbol AND jw.i = s.i JOIN th ON th.symbol = s.symbol AND th.i = s.i JOIN lp ON lp.symbol = s.symbol AND lp.i = s.i)"
_CHAIN = lambda n: [ema("e1", "s", "c", n), ema("e2", "e1", "y", n), ema("e3", "e2", "y", n)]


def _held(x: str, start: str = "0") -> str:
    """The last value of x that is not null."""
    return f"coalesce(last_value({x} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING), {start})"


#: name: (CTEs after s, what is selected, from what)
RULES: dict[str, tuple[list[str], dict[str, str], str]] = {
    "sma": ([], {"sma": f"CASE WHEN i >= {N - 1} THEN {last('c', N)} ELSE 0 END"}, "s"),
    "ema_window": (
        [f"x AS (SELECT symbol, i, list(c) OVER (PARTITION BY symbol ORDER BY i ROWS {N - 1} PRECEDING) AS cs FROM s)"],
        {"ema": f"CASE WHEN i >= {N - 1} THEN list_reduce(cs, lambda a, b: a + (b - a) * 2.0 / {N + 1}) ELSE 0 END"},
        "x",
    ),
    "smma_window": ([], {"smma": f"CASE WHEN i >= {N - 1} THEN {last('c', N)} * {N - 1} / {N}.0 + c / {N}.0 ELSE 0 END"}, "s"),
    "lwma": (
        [f"x AS (SELECT symbol, i, list(c) OVER (PARTITION BY symbol ORDER BY i ROWS {N - 1} PRECEDING) AS cs FROM s)"],
        {"lwma": f"CASE WHEN i >= {N - 1} THEN list_sum(list_transform(cs, lambda v, k: v * k)) / {N * (N + 1) // 2} ELSE 0 END"},
        "x",
    ),
    "ema_first": ([ema("e", "s", "c", N)], {"ema": "y"}, "e"),
    "ema_seeded": (seeded("e", "s", "c", N, 2 / (N + 1)), {"ema": "y"}, "e"),
    "smma_seeded": (seeded("e", "s", "c", N, 1 / N), {"smma": "y"}, "e"),
    "smma_expanding": (
        [f"x AS MATERIALIZED (SELECT *, {so_far('c', 'avg')} AS m FROM s)", walk("e", "x", "c", f"CASE WHEN q.i < {N} THEN q.m ELSE (r.y * {N - 1} + q.c) / {N} END")],
        {"smma": "y"},
        "e",
    ),
    "smma_zero": ([zero_smoothed("e", "s", "c")], {"smma": "y"}, "e"),
    "true_range": ([_P], {"tr": TR}, "p"),
    "atr": ([_P, f"t AS MATERIALIZED (SELECT symbol, i, {TR} AS x FROM p)", *seeded("e", "t", "x", N, 1 / N, 1)], {"atr": "y"}, "e"),
    "adx": (
        [_MOVES, "u AS MATERIALIZED (SELECT symbol, i, CASE WHEN tr <> 0 THEN 100 * pdm / tr ELSE 0 END AS x FROM d)", "t AS MATERIALIZED (SELECT symbol, i, CASE WHEN tr <> 0 THEN 100 * ndm / tr ELSE 0 END AS x FROM d)",
         ema("e", "u", "x", N), ema("f", "t", "x", N), f"z AS MATERIALIZED (SELECT symbol, i, a, b, {_DX} AS x FROM (SELECT e.symbol, e.i, e.y AS a, f.y AS b FROM e JOIN f ON f.symbol = e.symbol AND f.i = e.i))", ema("g", "z", "x", N)],
        {"adx": "y", "plus_di": "a", "minus_di": "b"},
        "(SELECT z.*, g.y FROM z JOIN g ON g.symbol = z.symbol AND g.i = z.i)",
    ),
    "adx_wilder": (
        [_MOVES, zero_smoothed("e", "d", "tr"), zero_smoothed("f", "d", "pdm"), zero_smoothed("g", "d", "ndm"),
         f"z AS MATERIALIZED (SELECT *, {_DX} AS x FROM (SELECT e.symbol, e.i, CASE WHEN e.y <> 0 THEN 100 * f.y / e.y ELSE 0 END AS a, CASE WHEN e.y <> 0 THEN 100 * g.y / e.y ELSE 0 END AS b FROM e JOIN f ON f.symbol = e.symbol AND f.i = e.i JOIN g ON g.symbol = e.symbol AND g.i = e.i))",
         zero_smoothed("k", "z", "x")],
        {"adx": "y", "plus_di": "a", "minus_di": "b"},
        "(SELECT z.*, k.y FROM z JOIN k ON k.symbol = z.symbol AND k.i = z.i)",
    ),
    "alligator": (_LIPS, {n: f"CASE WHEN i >= {p + k} THEN {ago(x, k)} ELSE 0 END" for n, x, p, k in (("jaws", "jw", 13, 8), ("teeth", "th", 8, 5), ("lips", "lp", 5, 3))}, _BODY),
    "gator": (
        [*_LIPS, f"u AS MATERIALIZED (SELECT symbol, i, CASE WHEN i >= 16 THEN abs({ago('jw', 3)} - th) ELSE 0 END AS up, CASE WHEN i >= 10 THEN -abs({ago('th', 2)} - lp) ELSE 0 END AS dn FROM {_BODY})",
         f"t AS MATERIALIZED (SELECT *, coalesce({ago('up')}, 0) AS pu, coalesce({ago('dn')}, 0) AS pd FROM u)",
         walk("ku", "t", "0", "CASE WHEN q.i < 16 THEN 0 WHEN q.pu = q.up THEN r.y WHEN q.pu < q.up THEN 0 ELSE 1 END"),
         walk("kd", "t", "0", "CASE WHEN q.i < 10 THEN 0 WHEN q.pd = q.dn THEN r.y WHEN q.pd < q.dn THEN 1 ELSE 0 END")],
        {"upper": "up", "upper_color": "ku", "lower": "dn", "lower_color": "kd"},
        "(SELECT t.*, ku.y AS ku, kd.y AS kd FROM t JOIN ku ON ku.symbol = t.symbol AND ku.i = t.i JOIN kd ON kd.symbol = t.symbol AND kd.i = t.i)",
    ),
    "ama": (
        [f"x AS MATERIALIZED (SELECT symbol, i, c, {ago('c', 9)} AS far, abs(c - {ago('c')}) AS d FROM s)",
         f"z AS MATERIALIZED (SELECT *, CASE WHEN n <> 0 THEN pow(abs(c - far) / n * (2 / 3.0 - 2 / 31.0) + 2 / 31.0, 2) ELSE pow(2 / 31.0, 2) END AS k FROM (SELECT *, {last('d', 9, 'sum')} AS n FROM x))",
         walk("e", "z", "0", "CASE WHEN q.i < 8 THEN 0 WHEN q.i = 8 THEN q.c ELSE r.y + q.k * (q.c - r.y) END")],
        {"ama": "y"}, "e",
    ),
    "asi": (
        [_P, f"x AS (SELECT symbol, i, CASE WHEN i = 0 THEN 0 WHEN rr = 0 THEN 0 ELSE 50 * (c - pc + (c - o) / 2 + (pc - po) / 4) / rr * greatest(abs(h - pc), abs(l - pc)) / 300 END AS si FROM (SELECT *, {TR} - CASE WHEN pc > h THEN pc - h WHEN pc < l THEN l - pc ELSE 0 END / 2 + abs(pc - po) / 4 AS rr FROM p))"],
        {"asi": so_far("si")}, "x",
    ),
    "bollinger": (
        [f"x AS (SELECT symbol, i, CASE WHEN i >= 19 THEN {last('c', 20)} ELSE 0 END AS m, CASE WHEN i >= 20 THEN {last('c', 20, 'stddev_pop')} ELSE 0 END AS d FROM s)"],
        {"middle": "m", "upper": "m + 2 * d", "lower": "m - 2 * d"},
        "x",
    ),
    "stddev": ([], {"sd": f"CASE WHEN i >= 19 THEN {last('c', 20, 'stddev_pop')} ELSE 0 END"}, "s"),
    "bulls_power": ([ema("e", "s", "c", N)], {"bulls": "h - e"}, meet("e")),
    "bears_power": ([ema("e", "s", "c", N)], {"bears": "l - e"}, meet("e")),
    "awesome": ([_AO], {"ao": "a"}, "ao"),
    "accelerator": ([_AC], {"ac": "k"}, "ac"),
    "bw_zone": (
        [_AC, f"z AS (SELECT symbol, i, sign(a - {ago('a')}) AS x, sign(k - {ago('k')}) AS y FROM ac)"],
        {"color": "CASE WHEN x = 1 AND y = 1 THEN 0 WHEN x = -1 AND y = -1 THEN 1 ELSE 2 END"},
        "z",
    ),
    "cci": (
        [f"x AS (SELECT symbol, i, c, list(c) OVER (PARTITION BY symbol ORDER BY i ROWS {N - 1} PRECEDING) AS cs FROM s)",
         f"z AS (SELECT symbol, i, c - list_avg(cs) AS d, list_sum(list_transform(cs, lambda v: abs(v - list_avg(cs)))) / {N} * 0.015 AS m FROM x)"],
        {"cci": f"CASE WHEN i >= {N - 1} AND m <> 0 THEN d / m ELSE 0 END"}, "z",
    ),
    "ad_line": ([_AD], {"ad": "y"}, "w"),
    "chaikin_oscillator": ([_AD, *seeded("f", "w", "y", 3, 0.5), *seeded("g", "w", "y", 10, 2 / 11)], {"cho": "f - g"}, meet("f", "g")),
    "chaikin_volatility": (
        ["x AS MATERIALIZED (SELECT symbol, i, h - l AS d FROM s)", ema("e", "x", "d", 10), f"z AS (SELECT symbol, i, y, {ago('y', 10)} AS b FROM e)"],
        {"chv": "CASE WHEN i >= 18 AND b <> 0 THEN 100 * (y - b) / b ELSE 0 END"},
        "z",
    ),
    "dema": (_CHAIN(N)[:2], {"dema": "2 * e1 - e2"}, meet("e1", "e2")),
    "tema": (_CHAIN(N), {"tema": f"CASE WHEN count(*) OVER (PARTITION BY symbol) < {3 * N - 3} THEN 0 ELSE 3 * e1 - 3 * e2 + e3 END"}, meet("e1", "e2", "e3")),
    "trix": ([*_CHAIN(N), f"z AS (SELECT symbol, i, y, {ago('y')} AS b FROM e3)"], {"trix": f"CASE WHEN i >= {3 * N - 3} AND b <> 0 THEN y / b - 1 ELSE 0 END"}, "z"),
    "demarker": (
        [_P, f"x AS (SELECT symbol, i, {last('CASE WHEN h > ph THEN h - ph ELSE 0 END', N, 'sum')} AS a, {last('CASE WHEN l < pl THEN pl - l ELSE 0 END', N, 'sum')} AS b FROM p)"],
        {"demarker": f"CASE WHEN i >= {N} AND a + b <> 0 THEN a / (a + b) ELSE 0 END"},
        "x",
    ),
    "dpo": ([f"x AS (SELECT *, CASE WHEN i >= 11 THEN {last('c', 12)} ELSE 0 END AS m FROM s)"], {"dpo": f"CASE WHEN i >= 18 THEN c - {ago('m', 7)} ELSE 0 END"}, "x"),
    "envelopes": ([], {k: f"CASE WHEN i >= {N - 1} THEN {last('c', N)} * {f} ELSE 0 END" for k, f in (("upper", "1.001"), ("lower", "0.999"))}, "s"),
    "force_index": ([f"x AS (SELECT symbol, i, coalesce(v * (c - {ago('c')}), 0) AS f FROM s)"], {"force": "CASE WHEN i >= 12 THEN " + last("f", 13) + " ELSE 0 END"}, "x"),
    "fractals": (
        [f"x AS (SELECT symbol, i, h, l, list(h) OVER w AS hs, list(l) OVER w AS ls FROM s WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"],
        {"upper": "CASE WHEN len(hs) = 5 AND h >= hs[1] AND h >= hs[2] AND h > hs[4] AND h > hs[5] THEN h ELSE 0 END", "lower": "CASE WHEN len(ls) = 5 AND l <= ls[1] AND l <= ls[2] AND l < ls[4] AND l < ls[5] THEN l ELSE 0 END"},
        "x",
    ),
    "frama": (
        [f"x AS MATERIALIZED (SELECT symbol, i, c, ({last('h', 14, 'max')} - {last('l', 14, 'min')}) / 14 AS n1, ({last('h', 28, 'max')} - {last('l', 28, 'min')}) / 28 AS n3 FROM s)",
         f"z AS MATERIALIZED (SELECT *, CASE WHEN n1 + n2 > 0 AND n3 > 0 THEN greatest(0, least(1, exp(-4.6 * (log2((n1 + n2) / n3) - 1)))) ELSE 0 END AS k FROM (SELECT *, {ago('n1', 14)} AS n2 FROM x))",
         walk("e", "z", "c", "CASE WHEN q.i < 27 THEN q.c ELSE r.y + q.k * (q.c - r.y) END")],
        {"frama": "CASE WHEN count(*) OVER (PARTITION BY symbol) < 28 THEN 0 ELSE y END"}, "e",
    ),
    "heiken_ashi": (
        [f"x AS MATERIALIZED (SELECT *, CASE WHEN i = 0 THEN c ELSE (o + h + l + c) / 4 END AS k FROM s)", f"z AS MATERIALIZED (SELECT *, {ago('k')} AS pk FROM x)", walk("e", "z", "o", "(r.y + q.pk) / 2")],
        {"ha_open": "y", "ha_high": "CASE WHEN i = 0 THEN h ELSE greatest(h, y, k) END", "ha_low": "CASE WHEN i = 0 THEN l ELSE least(l, y, k) END", "ha_close": "k", "color": "CASE WHEN y > k THEN 1 ELSE 0 END"},
        "(SELECT z.*, e.y FROM z JOIN e ON e.symbol = z.symbol AND e.i = z.i)",
    ),
    "ichimoku": (
        ["x AS (SELECT symbol, i, c, " + ", ".join(f"({last('h', k, 'max')} + {last('l', k, 'min')}) / 2 AS m{k}" for k in (9, 26, 52)) + " FROM s)"],
        {"tenkan": "m9", "kijun": "m26", "span_a": f"coalesce({ago('(m9 + m26) / 2', 26)}, 0)", "span_b": f"coalesce({ago('m52', 26)}, 0)", "chikou": f"coalesce({ago('c', 26)}, 0)"},
        "x",
    ),
    "macd": (_MACD, {"macd": "d", "signal": "y"}, "(SELECT m.*, sig.y FROM m JOIN sig ON sig.symbol = m.symbol AND sig.i = m.i)"),
    "osma": (_MACD, {"osma": "d - y"}, "(SELECT m.*, sig.y FROM m JOIN sig ON sig.symbol = m.symbol AND sig.i = m.i)"),
    "mass_index": (
        ["x AS MATERIALIZED (SELECT symbol, i, h - l AS d FROM s)", ema("e", "x", "d", 9), ema("f", "e", "y", 9)],
        {"mass": f"CASE WHEN i >= 40 THEN {last('CASE WHEN f <> 0 THEN e / f ELSE 0 END', 25, 'sum')} ELSE 0 END"},
        meet("e", "f"),
    ),
    "market_facilitation": (
        [f"x AS (SELECT *, {_held('CASE WHEN v <> 0 THEN (h - l) / v / 0.0001 END')} AS m FROM s)", f"z AS (SELECT *, coalesce(m > {ago('m')}, true) AS a, coalesce(v > {ago('v')}, true) AS b FROM x)"],
        {"mfi": "m", "color": "CASE WHEN a THEN CASE WHEN b THEN 0 ELSE 2 END WHEN b THEN 3 ELSE 1 END"},
        "z",
    ),
    "obv": ([_P], {"obv": so_far("CASE WHEN i = 0 THEN v ELSE sign(c - pc) * v END")}, "p"),
    "price_channel": (
        [f"x AS (SELECT symbol, i, CASE WHEN i >= 21 THEN {last('h', 22, 'max')} ELSE 0 END AS a, CASE WHEN i >= 21 THEN {last('l', 22, 'min')} ELSE 0 END AS b FROM s WHERE true)"],
        {"upper": "CASE WHEN i >= 22 THEN a ELSE 0 END", "lower": "CASE WHEN i >= 22 THEN b ELSE 0 END", "middle": "CASE WHEN i >= 22 THEN (a + b) / 2 ELSE 0 END"},
        "x",
    ),
    "pvt": ([_P], {"pvt": so_far("CASE WHEN i = 0 OR pc = 0 THEN 0 ELSE (c / pc - 1) * v END")}, "p"),
    "roc": ([], {"roc": f"CASE WHEN i >= 12 THEN (c / {ago('c', 12)} - 1) * 100 ELSE 0 END"}, "s"),
    "momentum": ([], {"momentum": f"CASE WHEN i >= {N} THEN c / {ago('c', N)} * 100 ELSE 0 END"}, "s"),
    "rsi": (
        [_P, "u AS MATERIALIZED (SELECT symbol, i, CASE WHEN c > pc THEN c - pc ELSE 0 END AS x FROM p)", "t AS MATERIALIZED (SELECT symbol, i, CASE WHEN c < pc THEN pc - c ELSE 0 END AS x FROM p)", *seeded("e", "u", "x", N, 1 / N, 1), *seeded("f", "t", "x", N, 1 / N, 1)],
        {"rsi": f"CASE WHEN i < {N} THEN 0 WHEN f <> 0 THEN 100 * e / (e + f) WHEN e <> 0 THEN 100 ELSE 50 END"},
        meet("e", "f"),
    ),
    "rvi": (
        ["x AS (SELECT symbol, i, list(c - o) OVER w AS a, list(h - l) OVER w AS b FROM s WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 3 PRECEDING))",
         "y AS (SELECT symbol, i, CASE WHEN len(a) = 4 THEN a[1] + 2 * a[2] + 2 * a[3] + a[4] END AS u, CASE WHEN len(b) = 4 THEN b[1] + 2 * b[2] + 2 * b[3] + b[4] END AS d FROM x)",
         f"z AS (SELECT symbol, i, CASE WHEN i < 12 THEN 0 WHEN d <> 0 THEN u / d ELSE u END AS r FROM (SELECT symbol, i, {last('u', 10, 'sum')} AS u, {last('d', 10, 'sum')} AS d FROM y))",
         "q AS (SELECT symbol, i, r, list(r) OVER (PARTITION BY symbol ORDER BY i ROWS 3 PRECEDING) AS rs FROM z)"],
        {"rvi": "r", "signal": "CASE WHEN i >= 15 THEN (rs[1] + 2 * rs[2] + 2 * rs[3] + rs[4]) / 6 ELSE 0 END"}, "q",
    ),
    "stochastic": (
        [f"x AS (SELECT symbol, i, c, {last('h', 5, 'max')} AS a, {last('l', 5, 'min')} AS b FROM s)", "y AS (SELECT symbol, i, CASE WHEN i < 4 THEN 0 WHEN a = b THEN 100 ELSE 100 * (c - b) / (a - b) END AS r FROM x)",
         f"z AS (SELECT symbol, i, CASE WHEN i >= 6 THEN {last('r', 3)} ELSE 0 END AS m FROM y)"],
        {"main": "m", "signal": f"CASE WHEN i >= 2 THEN {last('m', 3)} ELSE 0 END"}, "z",
    ),
    "ultimate": (
        [_P, f"x AS (SELECT symbol, i, {TR} AS t, CASE WHEN i = 0 THEN 0 ELSE c - least(l, pc) END AS b FROM p)", "y AS (SELECT symbol, i, " + ", ".join(f"{last('b', k, 'sum')} AS b{k}, {last('t', k, 'sum')} AS t{k}" for k in (7, 14, 28)) + " FROM x)"],
        {"uo": "CASE WHEN i >= 28 THEN 100 * (4 * coalesce(b7 / nullif(t7, 0), 0) + 2 * coalesce(b14 / nullif(t14, 0), 0) + coalesce(b28 / nullif(t28, 0), 0)) / 7 ELSE 0 END"},
        "y",
    ),
    "vidya": (
        [_P, f"x AS (SELECT symbol, i, c, {so_far('c', 'avg')} AS m, {last('CASE WHEN c > pc THEN c - pc ELSE 0 END', 9, 'sum')} AS a, {last('CASE WHEN c < pc THEN pc - c ELSE 0 END', 9, 'sum')} AS b FROM p)",
         "z AS MATERIALIZED (SELECT *, 2 / 13.0 * CASE WHEN a + b <> 0 THEN abs(a - b) / (a + b) ELSE 0 END AS k FROM x)", walk("e", "z", "m", "CASE WHEN q.i < 12 THEN q.m ELSE r.y + q.k * (q.c - r.y) END")],
        {"vidya": "y"}, "e",
    ),
    "volumes": ([], {"color": f"CASE WHEN v > {ago('v')} THEN 0 ELSE 1 END"}, "s"),
    "vroc": ([f"x AS (SELECT symbol, i, CASE WHEN i < 25 THEN 0 ELSE 100.0 * v / nullif({ago('v', 25)}, 0) - 100 END AS r FROM s)"], {"vroc": _held("r")}, "x"),
    "wad": ([_P], {"wad": so_far("CASE WHEN i = 0 OR abs(c - pc) <= 0.0001 THEN 0 WHEN c > pc THEN c - least(l, pc) ELSE c - greatest(h, pc) END")}, "p"),
    "wpr": (
        [f"x AS (SELECT symbol, i, c, {last('h', N, 'max')} AS a, {last('l', N, 'min')} AS b FROM s)"],
        {"wpr": _held(f"CASE WHEN i < {N - 1} THEN 0 WHEN a <> b THEN -100 * (a - c) / (a - b) END")},
        "x",
    ),
    "color_bars": ([f"x AS (SELECT symbol, i, v, {ago('v')} AS pv FROM s)"], {"color": _held("CASE WHEN v > pv THEN 0 WHEN v < pv THEN 1 END")}, "x"),
    "keltner": (
        [_P, f"x AS (SELECT symbol, i, {last(TR, 10)} AS a FROM p)", ema("e", "s", "c", 20)],
        {"middle": "y", "upper": "y + 2 * a", "lower": "y - 2 * a"},
        "(SELECT x.*, e.y FROM x JOIN e ON e.symbol = x.symbol AND e.i = x.i)",
    ),
}

# The day before: levels by their own arithmetic.
_DAYS = """g AS (SELECT symbol, CAST(ts AS DATE) AS day, arg_min(o, i) AS o, max(h) AS h, min(l) AS l, arg_max(c, i) AS c FROM s GROUP BY ALL),
 y AS (SELECT s.symbol, s.i, g.o AS o, g.h AS h, g.l AS l, g.c AS c, g.h - g.l AS r, (g.h + g.l + g.c) / 3 AS p, (g.h + g.l + 2 * g.c) / 4 AS w,
   g.h + g.l + g.c + CASE WHEN g.c < g.o THEN g.l WHEN g.c > g.o THEN g.h ELSE g.c END AS x
   FROM s ASOF LEFT JOIN g ON g.symbol = s.symbol AND g.day < CAST(s.ts AS DATE))"""
_LEVELS = {
    "pivot_camarilla": {**{f"r{k}": f"c + 1.1 * r / {d}" for k, d in enumerate((12, 6, 4, 2), 1)}, **{f"s{k}": f"c - 1.1 * r / {d}" for k, d in enumerate((12, 6, 4, 2), 1)}, "r5": "h / l * c", "s5": "c - (h / l * c - c)"},
    "pivot_classic": {"pp": "p", "r1": "p + p - l", "s1": "p + p - h", "r2": "p + r", "s2": "p - r", "m1": "(3 * p - h - r) / 2", "m2": "(3 * p - h) / 2", "m3": "(3 * p - l) / 2", "m4": "(3 * p - l + r) / 2"},
    "pivot_fibonacci": {"pp": "p", **{f"{s}{k}": f"p {o} r * {f}" for k, f in enumerate((0.382, 0.618, 1, 1.618), 1) for s, o in (("r", "+"), ("s", "-"))}},
    "pivot_woodie": {"pp": "w", **{f"r{k}": f"{'2 * w - l' if k % 2 else 'w'} + {k // 2} * r" if k != 4 else "2 * w - l + 2 * r" for k in range(1, 5)}, **{f"s{k}": f"{'2 * w - h' if k % 2 else 'w'} - {k // 2} * r" if k != 4 else "2 * w - h - 2 * r" for k in range(1, 5)}},
    "pivot_demark": {"pp": "x / 4", "r1": "x / 2 - l", "s1": "x / 2 - h"},
}
RULES |= {name: ([_DAYS], {k: f"coalesce({e}, 0)" for k, e in levels.items()}, "y") for name, levels in _LEVELS.items()}

# Candles: z, y, x are the last bar and the two before it, each a struct of o, h, l, c.
_CANDLES = f"""k AS (SELECT symbol, i, {{'o': o, 'h': h, 'l': l, 'c': c}} AS z, {last('abs(c - o)', 12)} AS big, {last('c', 5)} AS m FROM s),
 t AS (SELECT *, {ago('z')} AS y, {ago('z', 2)} AS x, {ago('m')} AS trend FROM k)"""
_HITS = {
    "candle_bullish_engulfing": "y.o > y.c AND z.c - z.o > big AND z.c > y.o AND z.o < y.c AND y.o + y.c < 2 * trend",
    "candle_bearish_engulfing": "y.c > y.o AND z.o - z.c > big AND z.c < y.o AND z.o > y.c AND y.o + y.c > 2 * trend",
    "candle_bullish_harami": "y.o - y.c > big AND z.c > z.o AND z.c < y.o AND z.o > y.c AND y.h + y.l < 2 * trend",
    "candle_bearish_harami": "y.c - y.o > big AND z.o > z.c AND z.c > y.o AND z.o < y.c AND y.h + y.l > 2 * trend",
    "candle_piercing_line": "z.c - z.o > big AND y.o - y.c > big AND z.c > y.c AND z.c < y.o AND z.o < y.l AND y.o + y.c < 2 * trend",
    "candle_dark_cloud": "y.c - y.o > big AND z.c < y.c AND z.c > y.o AND z.o > y.h AND y.o + y.c > 2 * trend",
    "candle_three_soldiers": "least(x.c - x.o, y.c - y.o, z.c - z.o) > big AND x.h + x.l < y.h + y.l AND y.h + y.l < z.h + z.l",
    "candle_three_crows": "least(x.o - x.c, y.o - y.c, z.o - z.c) > big AND x.h + x.l > y.h + y.l AND y.h + y.l > z.h + z.l",
    "candle_meeting_lines_bullish": "least(y.o - y.c, z.c - z.o) > big AND abs(z.c - y.c) < big / 10",
    "candle_meeting_lines_bearish": "least(y.c - y.o, z.o - z.c) > big AND abs(z.c - y.c) < big / 10",
    "candle_morning_star": "x.o - x.c > big AND abs(y.c - y.o) < big / 2 AND greatest(y.c - x.c, y.o - x.o) < 0 AND 2 * z.c > x.o + x.c",
    "candle_evening_star": "x.c - x.o > big AND abs(y.c - y.o) < big / 2 AND least(y.c - x.c, y.o - x.o) > 0 AND 2 * z.c < x.o + x.c",
    "candle_morning_doji": "x.o - x.c > big AND abs(y.c - y.o) < big / 10 AND greatest(y.c - x.c, y.o - x.o) < 0 AND least(z.o, z.c) > y.c",
    "candle_evening_doji": "x.c - x.o > big AND abs(y.c - y.o) < big / 10 AND least(y.c - x.c, y.o - x.o) > 0 AND greatest(z.o, z.c) < y.c",
    "candle_hammer": "z.h + z.l < 2 * trend AND least(z.o, z.c) > z.h - (z.h - z.l) / 3.0 AND z.c < y.c AND z.o < y.o",
    "candle_hanging_man": "z.h + z.l > 2 * trend AND least(z.o, z.c) > z.h - (z.h - z.l) / 3.0 AND z.c > y.c AND z.o > y.o",
}
RULES |= {name: ([_CANDLES], {"hit": f"CASE WHEN i >= 12 AND {test} THEN 1 ELSE 0 END"}, "t") for name, test in _HITS.items()}


def statement(name: str) -> str:
    """The SQL of an indicator: symbol, i and its outputs, rounded as the queries are."""
    ctes, outputs, source = RULES[name]
    bars = f"s AS MATERIALIZED (WITH {bars_sql(60)} SELECT symbol, ts, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS INT) AS i, open AS o, high AS h, low AS l, close AS c, volume AS v FROM b)"
    out = ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {k}" for k, e in outputs.items())
    return f"WITH RECURSIVE {bars}{''.join(', ' + c for c in ctes)}\nSELECT symbol, i, {out} FROM {source}"


def _bars_cte() -> str:
    return f"""s AS MATERIALIZED (WITH {bars_sql(60)} SELECT symbol, ts, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS INT) AS i, open AS o, high AS h, low AS l, close AS c, volume AS v FROM b),
 p AS MATERIALIZED (SELECT *, {ago('h')} AS ph, {ago('l')} AS pl, max(i) OVER (PARTITION BY symbol) AS z FROM s)"""


#: Stop and reverse as a walk: each row holds the trend, stop, peak, pace and farthest price that its bar meets.
STOP_AND_REVERSE = f"""WITH RECURSIVE {_bars_cte()},
 r AS (SELECT symbol, i, -1 AS way, greatest(h, ph) AS stop, l AS peak, 0.02::DOUBLE AS pace, least(l, pl) AS far FROM p WHERE i = 1
  UNION ALL SELECT symbol, i + 1, way, CASE WHEN way = 1 THEN least(stop + pace * (peak - stop), l, pl) ELSE greatest(stop + pace * (peak - stop), h, ph) END, peak, pace, far FROM (
   SELECT q.symbol, q.i, q.h, q.l, q.ph, q.pl, CASE WHEN turn THEN -way ELSE way END AS way, CASE WHEN turn THEN edge ELSE stop END AS stop,
    CASE WHEN turn THEN CASE WHEN way = 1 THEN q.l ELSE q.h END WHEN better THEN CASE WHEN way = 1 THEN q.h ELSE q.l END ELSE peak END AS peak,
    CASE WHEN turn THEN 0.02 WHEN better THEN least(pace + 0.02, 0.2) ELSE pace END AS pace, CASE WHEN turn THEN CASE WHEN way = 1 THEN q.l ELSE q.h END ELSE edge END AS far
   FROM (SELECT p.symbol, p.i, p.h, p.l, p.ph, p.pl, r.way, r.stop, r.peak, r.pace, CASE WHEN r.way = 1 THEN r.stop > p.l ELSE r.stop < p.h END AS turn,
     CASE WHEN r.way = 1 THEN p.h > r.peak ELSE p.l < r.peak END AS better, CASE WHEN r.way = 1 THEN greatest(r.far, p.h) ELSE least(r.far, p.l) END AS edge
     FROM r JOIN p ON p.symbol = r.symbol AND p.i = r.i WHERE p.i < p.z) q)),
 e AS (SELECT p.symbol, p.i, CASE WHEN p.z = 0 THEN 0.0 WHEN p.i = 0 THEN p.h WHEN p.i < p.z AND CASE WHEN r.way = 1 THEN r.stop > p.l ELSE r.stop < p.h END
   THEN CASE WHEN r.way = 1 THEN greatest(r.far, p.h) ELSE least(r.far, p.l) END ELSE r.stop END AS sar FROM p LEFT JOIN r ON r.symbol = p.symbol AND r.i = p.i)
 SELECT symbol, i, round(sar, 6) AS sar FROM e"""

#: The trailing stop as a walk over closes: side and best close since it turned.
TRAILING = f"""WITH RECURSIVE {_bars_cte()},
 r AS (SELECT symbol, i, 1 AS side, c AS best FROM p WHERE i = 0
  UNION ALL SELECT symbol, i, CASE WHEN out THEN -side ELSE side END, CASE WHEN out THEN c ELSE best END FROM (
   SELECT symbol, i, c, side, best, CASE WHEN side = 1 THEN c < best * (1 - 0.02::DOUBLE) ELSE c > best * (1 + 0.02::DOUBLE) END AS out FROM (
    SELECT p.symbol, p.i, p.c, r.side, CASE WHEN r.side = 1 THEN greatest(r.best, p.c) ELSE least(r.best, p.c) END AS best FROM r JOIN p ON p.symbol = r.symbol AND p.i = r.i + 1)))
 SELECT symbol, i, round(best * (1 - side * 0.02::DOUBLE), 6) AS stop, round(side::DOUBLE, 6) AS side FROM r"""


#: Zigzag of 12, 5, 3: candidates k by k; a leg's last replacement is its end.
ZIGZAG = f"""WITH RECURSIVE {_bars_cte()},
 w AS (SELECT symbol, i, h, l, {last('h', 12, 'max')} AS hh, {last('l', 12, 'min')} AS ll FROM s),
 n AS (SELECT *, i >= 12 AND (i = 12 OR hh <> {ago('hh')}) AND hh - h <= 0.00005 AS nh, i >= 12 AND (i = 12 OR ll <> {ago('ll')}) AND l - ll <= 0.00005 AS nl FROM w),
 f AS (SELECT *, list(CASE WHEN nh THEN hh END) OVER x AS hs, list(CASE WHEN nl THEN ll END) OVER x AS ls FROM n WINDOW x AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
 m AS (SELECT symbol, i, CASE WHEN nh AND h = hh AND coalesce(list_max(hs), h) <= h THEN h END AS a, CASE WHEN nl AND l = ll AND coalesce(list_min(ls), l) >= l THEN l END AS b FROM f),
 k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i) AS k FROM m WHERE a IS NOT NULL OR b IS NOT NULL),
 r AS (SELECT symbol, k, CASE WHEN a IS NOT NULL THEN 1 ELSE -1 END AS way, coalesce(a, b) AS price, 1 AS leg, true AS used FROM k WHERE k = 1
  UNION ALL SELECT k.symbol, k.k,
   CASE WHEN way = 1 THEN CASE WHEN a > price THEN 1 WHEN b IS NOT NULL THEN -1 ELSE 1 END ELSE CASE WHEN b < price THEN -1 WHEN a IS NOT NULL THEN 1 ELSE -1 END END,
   CASE WHEN way = 1 THEN CASE WHEN a > price THEN a WHEN b IS NOT NULL THEN b ELSE price END ELSE CASE WHEN b < price THEN b WHEN a IS NOT NULL THEN a ELSE price END END,
   leg + CASE WHEN way = 1 AND coalesce(a <= price, true) AND b IS NOT NULL THEN 1 WHEN way = -1 AND coalesce(b >= price, true) AND a IS NOT NULL THEN 1 ELSE 0 END,
   CASE WHEN way = 1 THEN coalesce(a > price, false) OR b IS NOT NULL ELSE coalesce(b < price, false) OR a IS NOT NULL END
  FROM r JOIN k ON k.symbol = r.symbol AND k.k = r.k + 1)
 SELECT symbol, i, round(way::DOUBLE, 6) AS "pivot", round(price, 6) AS price FROM (SELECT k.symbol, k.i, r.way, r.price, row_number() OVER (PARTITION BY r.symbol, leg ORDER BY r.k DESC) AS back
  FROM r JOIN k ON k.symbol = r.symbol AND k.k = r.k WHERE used) WHERE back = 1"""
