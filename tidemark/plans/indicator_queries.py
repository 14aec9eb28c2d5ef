"""One query per indicator over hourly bars, beside SQL that states its rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import indicators as I
from ..operators import patterns as P
from ..session import table
from .define import QUERIES, SQL
from .indicator_sql import STOP_AND_REVERSE, TRAILING, ZIGZAG, statement


def hourly(spark, sf_dir, minutes: int = 60):
    t = B.ticks(table(spark, sf_dir, "events").where("value > 0"))
    return B.numbered(B.from_ticks(t, minutes))


def _rounded(df, outputs):
    return df.select("symbol", "i", *[F.round(F.col(o).cast("double"), 6).alias(o) for o in outputs])


def _register() -> None:
    made = {n: (lambda b, i=i: I.compute(b, i), i.outputs) for n, i in I.catalogue().items()}
    made |= {n: (lambda b, n=n: P.pivots(b, n), P.outputs(n)) for n in P.LEVELS}
    made |= {n: (lambda b, n=n: P.candles(b, n), ["hit"]) for n in P.PATTERNS}
    for name, (compute, outputs) in made.items():
        QUERIES[f"ind_{name}"] = lambda spark, sf_dir, compute=compute, outputs=outputs: _rounded(compute(hourly(spark, sf_dir)), outputs)
        SQL[f"ind_{name}"] = statement(name)
    QUERIES["ind_parabolic_sar"] = lambda spark, sf_dir: _rounded(I.parabolic_sar(hourly(spark, sf_dir)), ["sar"])
    QUERIES["ind_trailing_reverse"] = lambda spark, sf_dir: _rounded(I.trailing_reverse(hourly(spark, sf_dir)), ["stop", "side"])
    SQL["ind_parabolic_sar"], SQL["ind_trailing_reverse"], SQL["ind_zigzag"] = STOP_AND_REVERSE, TRAILING, ZIGZAG
    QUERIES["ind_zigzag"] = lambda spark, sf_dir: _rounded(I.zigzag(hourly(spark, sf_dir)), ["pivot", "price"])


_register()
