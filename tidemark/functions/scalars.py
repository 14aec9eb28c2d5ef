"""Dates, contract symbols, titles and rounding as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OCC = r"^(?:O:)?(.+)([0-9]{6})([CPcp])([0-9]{8})$"
#: Titles by ordered keyword rules, weights of roles, labels of transaction codes.
TITLES = [
    ("Unknown", "SEE REMARK"),
    ("Director", r"\bDIRECTOR\b"),
    ("CEO", r"CHIEF EXEC|\bCEO\b"),
    ("Chair", r"EXECUTIVE CHAIR|\b(CHAIR|CHAIRMAN)\b"),
    ("COO", r"\bCOO\b|CHIEF OPERATING"),
    ("CFO", r"\b(CFO|TREASURER)\b|CHIEF FINANCIAL"),
    ("CTO", r"\bCTO\b|CHIEF TECHNOLOGY"),
    ("Other C-Suite", r"\bCMO\b|CHIEF MARKETING|CHIEF MEDICAL"),
    ("CIO", r"\bCIO\b|CHIEF INVESTMENT"),
    ("General Counsel", "GENERAL COUNSEL"),
    ("VP", r"\b(VP|SVP|EVP)\b|VICE PRESIDENT"),
    ("President", r"\bPRESIDENT\b"),
]
ROLE_WEIGHTS = {"CEO": 4.0, "CFO": 3.5, "COO": 3.0, "General Counsel": 2.5, "Director": 1.25, "Board": 1.0}
CODES = {
    "P": "Purchase",
    "S": "Sale",
    "A": "Award",
    "D": "Disposition",
    "F": "Tax",
    "G": "Gift",
    "M": "Exercise",
    "C": "Conversion",
    "J": "Other",
}
ZONES = {
    **dict.fromkeys(("eastern", "us/eastern", "america/new_york", "est", "edt"), "America/New_York"),
    **dict.fromkeys(("central", "us/central", "america/chicago", "cst", "cdt"), "America/Chicago"),
    **dict.fromkeys(("mountain", "us/mountain", "america/denver", "mst", "mdt"), "America/Denver"),
    **dict.fromkeys(("pacific", "us/pacific", "pacific/los_angeles", "america/los_angeles", "pst", "pdt"), "America/Los_Angeles"),
    **dict.fromkeys(("hawaii", "us/hawaii", "pacific/honolulu", "hst"), "Pacific/Honolulu"),
    **dict.fromkeys(("utc", "gmt", "z"), "UTC"),
}


def occ(symbol: Column) -> Column:
    """struct(root, expiration, kind, strike), null if the symbol is none."""
    part = lambda k: F.regexp_extract(symbol, OCC, k)
    s = F.struct(
        part(1).alias("root"),
        F.try_to_timestamp(part(2), F.lit("yyMMdd")).cast("date").alias("expiration"),
        F.upper(part(3)).alias("kind"),
        (F.nullif(part(4), F.lit("")).cast("double") / 1000).alias("strike"),
    )
    return F.when(symbol.rlike(OCC), s)


def occ_symbol(root: Column, expiration: Column, kind: Column, strike: Column) -> Column:
    cents = F.lpad(F.round(strike * 1000).cast("long").cast("string"), 8, "0")
    return F.concat(F.lit("O:"), root, F.date_format(expiration, "yyMMdd"), kind, cents)


def third_friday(day: Column) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.trunc(day, "MM"), 1), "FRI"), 14)


def nth_weekday(day: Column, name: str, n: int) -> Column:
    """The n-th such weekday of the day's month."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(day, "MM"), 1), name), 7 * (n - 1))


def last_weekday(day: Column, name: str) -> Column:
    return F.next_day(F.date_sub(F.last_day(day), 7), name)


def next_trading_day(day: Column) -> Column:
    """The next day that is no Saturday or Sunday."""
    step = F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1)
    return F.date_add(day, step)


def easter(year: Column) -> Column:
    """Easter Sunday by the anonymous Gregorian computus."""
    a, b, c = year % 19, F.floor(year / 100), year % 100
    g = F.floor((8 * b + 13) / 25)
    h = (19 * a + b - F.floor(b / 4) - g + 15) % 30
    m = F.floor((a + 11 * h) / 319)
    r = (2 * (b % 4) + 2 * F.floor(c / 4) - c % 4 - h + m + 32) % 7
    month = F.floor((h - m + r + 90) / 25)
    return F.make_date(year.cast("int"), month.cast("int"), ((h - m + r + month + 19) % 32).cast("int"))


def _observed(day: Column) -> Column:
    return F.when(F.weekday(day) == 5, F.date_sub(day, 1)).when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)


def us_market_holiday(day: Column) -> Column:
    """The holiday's name, or null: the New York exchange's full closures by rule."""
    y = F.year(day)
    of = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    rules = [
        ("New Year", F.when(F.weekday(of(1, 1)) == 5, F.lit(None)).otherwise(_observed(of(1, 1)))),
        ("Martin Luther King", nth_weekday(of(1, 1), "MON", 3)),
        ("Presidents", nth_weekday(of(2, 1), "MON", 3)),
        ("Good Friday", F.date_sub(easter(y), 2)),
        ("Memorial", last_weekday(of(5, 1), "MON")),
        ("Juneteenth", F.when(y >= 2022, _observed(of(6, 19)))),
        ("Independence", _observed(of(7, 4))),
        ("Labor", nth_weekday(of(9, 1), "MON", 1)),
        ("Thanksgiving", nth_weekday(of(11, 1), "THU", 4)),
        ("Christmas", _observed(of(12, 25))),
    ]
    return F.coalesce(*[F.when(day == d.cast("date"), n) for n, d in rules])


def us_market_half_day(day: Column) -> Column:
    """Why the New York exchange closes at one on this weekday, or null: the eves of Independence Day, Christmas
    and New Year where the holiday is a weekday, and the day after Thanksgiving."""
    y = F.year(day)
    eve = lambda m, d, of: (F.month(day) == m) & (F.dayofmonth(day) == d) & (F.weekday(of) < 5)
    of = lambda m, d, year=y: F.make_date(year, F.lit(m), F.lit(d))
    name = (
        F.when(eve(7, 3, of(7, 4)), "Independence Eve")
        .when(F.date_sub(day, 1) == nth_weekday(of(11, 1), "THU", 4), "Day after Thanksgiving")
        .when(eve(12, 24, of(12, 25)), "Christmas Eve")
        .when(eve(12, 31, of(1, 1, y + 1)), "New Year's Eve")
    )
    return F.when(F.weekday(day) < 5, name)


def money(x: Column) -> Column:
    """Two decimals, half to even."""
    return F.bround(x, 2)


def title(raw: Column) -> Column:
    """An officer's title by the first keyword rule that fits; Other, or Unknown if blank."""
    t = F.trim(F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), "[^A-Z0-9]+", " "))
    out = F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", "Unknown")
    for name, rule in TITLES:
        out = out.when(t.rlike(rule), name)
    return out.otherwise("Other")


def role_weight(role: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for name, w in ROLE_WEIGHTS.items():
        out = out.when(role == name, w)
    return out.otherwise(1.0)


def code_label(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), F.upper(F.trim(code))), F.lit("Unknown"))


def truth(x: Column) -> Column:
    return F.lower(F.trim(x)).isin("1", "true", "yes")


def epoch_ns_to_eastern(ns: Column) -> Column:
    return F.from_utc_timestamp(F.timestamp_millis(F.floor(ns / 1_000_000).cast("long")), "America/New_York")


def safe_name(x: Column) -> Column:
    return F.substring(F.regexp_replace(x, r'[\\/:*?"<>|\s]', "_"), 1, 200)


def _let(value: Column, use) -> Column:
    """use(value) with value computed once: inside a fold nothing else shares subexpressions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _once(value: Column, use) -> Column:
    return use(value)


def normal_cdf(x: Column, bind=_once) -> Column:
    """Abramowitz and Stegun 26.2.17, clipped at 8 deviations; error below 7.5e-8."""

    def of(v: Column) -> Column:
        horner = lambda k: k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
        tail = F.exp(-v * v / 2) / math.sqrt(2 * math.pi) * bind(1 / (1 + F.lit(0.2316419) * F.abs(v)), horner)
        return bind(tail, lambda t: F.when(v > 8, 1.0).when(v < -8, 0.0).when(v >= 0, 1 - t).otherwise(t))

    return bind(x, of)


def black_scholes(s: Column, k: Column, t: Column, r: Column, q: Column, sigma: Column, call: Column, bind=_once) -> Column:
    """The price of a European option; at t = 0 or sigma = 0 what it is worth if nothing moves."""
    root = sigma * F.sqrt(t)
    fs, fk = s * F.exp(-q * t), k * F.exp(-r * t)

    def of(d1: Column) -> Column:
        d2 = d1 - root
        up = fs * normal_cdf(d1, bind) - fk * normal_cdf(d2, bind)
        return F.when(call, up).otherwise(fk * normal_cdf(-d2, bind) - fs * normal_cdf(-d1, bind))

    value = bind((F.ln(s / k) + (r - q + sigma * sigma / 2) * t) / F.nullif(root, F.lit(0.0)), of)
    still = F.when(call, F.greatest(fs - fk, F.lit(0.0))).otherwise(F.greatest(fk - fs, F.lit(0.0)))
    return F.when((t <= 0) | (sigma <= 0), still).otherwise(value)


def normal_cdf_of(v: np.ndarray) -> np.ndarray:
    """normal_cdf over an array."""
    k = 1 / (1 + 0.2316419 * np.abs(v))
    t = np.exp(-v * v / 2) / math.sqrt(2 * math.pi) * (k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))))
    return np.where(v > 8, 1.0, np.where(v < -8, 0.0, np.where(v >= 0, 1 - t, t)))


def black_scholes_of(s, k, t, r, q, sigma, call) -> np.ndarray:
    """black_scholes over arrays; NaN where an input is."""
    with np.errstate(all="ignore"):
        root = sigma * np.sqrt(t)
        fs, fk, sign = s * np.exp(-q * t), k * np.exp(-r * t), np.where(call, 1.0, -1.0)
        d1 = (np.log(s / k) + (r - q + sigma * sigma / 2) * t) / root
        value = sign * (fs * normal_cdf_of(sign * d1) - fk * normal_cdf_of(sign * (d1 - root)))
        return np.where((t <= 0) | (sigma <= 0), np.maximum(sign * (fs - fk), 0.0), value)


def over_arrays(solve, price: Column, s: Column, k: Column, t: Column, r: Column, q: Column, call: Column) -> Column:
    """solve(price, s, k, t, r, q, call) over arrays of a batch's rows; null where an input is null or the result NaN."""

    def run(*columns: pd.Series) -> pd.Series:
        *numbers, side = (c.to_numpy(np.float64) for c in columns)
        return pd.Series(solve(*numbers, side == 1))

    double = [c.cast("double") for c in (price, s, k, t, r, q)]
    return F.pandas_udf(run, "double")(*double, F.coalesce(call, F.lit(False)).cast("double"))


def implied_volatility(price: Column, s: Column, k: Column, t: Column, r: Column, q: Column, call: Column, rounds: int = 60) -> Column:
    """By bisection between 0 and 5, a batch of rows at a time. Null where an input is."""

    def solve(price, s, k, t, r, q, call):
        lo, hi = np.zeros(len(price)), np.full(len(price), 5.0)
        for _ in range(rounds):
            mid = (lo + hi) / 2
            under = black_scholes_of(s, k, t, r, q, mid, call) < price
            lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
        return np.where(np.isnan(price + s + k + t + r + q), np.nan, (lo + hi) / 2)

    return over_arrays(solve, price, s, k, t, r, q, call)
