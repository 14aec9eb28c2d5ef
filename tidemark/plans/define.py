"""How a query is registered next to the SQL that states its result."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register f(spark, sf_dir); sql, if any, gives the same rows from the same tables."""

    def add(f):
        n = name or f.__name__
        QUERIES[n] = f
        if sql:
            SQL[n] = sql
        return f

    return add


TICKS = "t AS MATERIALIZED (SELECT event_type AS symbol, ts, value AS price, user_id % 10 + 1 AS volume, event_id AS id FROM events WHERE value > 0)"


def bars_sql(minutes: int, name: str = "b") -> str:
    """CTEs t and `name`: bars of so many minutes from the events."""
    start = "date_trunc('day', ts)" if minutes >= 1440 else f"date_trunc('day', ts) + to_minutes(CAST((hour(ts) * 60 + minute(ts)) // {minutes} * {minutes} AS BIGINT))"
    return f"""{TICKS},
 {name} AS MATERIALIZED (SELECT symbol, bar AS ts, arg_min(price, (ts, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, id)) AS close,
   CAST(sum(volume) AS BIGINT) AS volume, sum(price * volume) / sum(volume) AS wap, count(*) AS n
   FROM (SELECT *, CAST({start} AS TIMESTAMP) AS bar FROM t) GROUP BY symbol, bar)"""


def stamp(c: str = "ts") -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
