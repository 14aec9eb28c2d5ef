"""Insider transactions: filter, weights and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_VALUE = 250_000.0


def flags(t: DataFrame) -> DataFrame:
    """code, direction, plan, security -> is_acquisition, is_disposition, is_open_market, is_derivative."""
    up = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    plan = F.coalesce(F.col("plan"), F.lit(False))
    return t.withColumns(
        {
            "is_acquisition": up(F.col("direction")) == "A",
            "is_disposition": up(F.col("direction")) == "D",
            "is_open_market": (up(F.col("code")) == "P") & (up(F.col("direction")) == "A") & ~plan,
            "is_derivative": F.coalesce(F.col("security"), F.lit("")).startswith("[DERIVATIVE]"),
        }
    )


def signals(t: DataFrame, least: float = LEAST_VALUE) -> DataFrame:
    """Purchases worth following: no plan, no derivative, a plain ticker, by a director or an
    officer, and worth `least` or more. Adds value = shares * price."""
    ticker = F.upper(F.trim(F.coalesce(F.col("ticker"), F.lit(""))))
    ok = (ticker != "") & ~ticker.contains(".") & ~ticker.isin("NONE", "N/A") & ~F.coalesce(F.col("plan"), F.lit(False))
    ok = ok & (F.upper(F.trim(F.coalesce(F.col("code"), F.lit("")))) == "P") & ~F.coalesce(F.col("security"), F.lit("")).startswith("[DERIVATIVE]")
    value = F.col("shares") * F.col("price")
    return t.where(ok).withColumn("value", value).where((F.col("value") >= least) & (F.col("is_director") | F.col("is_officer")))


def clusters(s: DataFrame) -> DataFrame:
    """Per ticker: distinct insiders, weight and value, and a tier of our own design:
    score = log10(value) - 5 + weight / 4 + (insiders - 1) / 2; A+ from 5, A from 3.5, B from 1, else C."""
    a = s.groupBy("ticker").agg(F.countDistinct("owner").alias("insiders"), F.sum("weight").alias("weight"), F.sum("value").alias("value"))
    score = F.log10(F.greatest("value", F.lit(1.0))) - 5 + F.col("weight") / 4 + (F.col("insiders") - 1) / 2
    tier = F.when(F.col("score") >= 5, "A+").when(F.col("score") >= 3.5, "A").when(F.col("score") >= 1, "B").otherwise("C")
    return a.withColumn("score", score).withColumn("tier", tier)
