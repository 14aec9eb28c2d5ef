"""The incomplete gamma and beta functions in SQL: sums of positive terms."""

from __future__ import annotations

TERMS = 1000


def gamma_sql(a: str, x: str, terms: int = TERMS) -> str:
    """The lower regularised incomplete gamma function."""
    return f"(CASE WHEN {x} <= 0 THEN 0.0 ELSE list_sum(list_transform(range(0, {terms}), lambda n: exp(-({x}) + ({a} + n) * ln({x}) - lgamma({a} + n + 1)))) END)"


def beta_sql(a: str, b: str, x: str, terms: int = TERMS) -> str:
    """The regularised incomplete beta function, for x not near 1."""
    return f"(CASE WHEN {x} <= 0 THEN 0.0 ELSE list_sum(list_transform(range(0, {terms}), lambda n: exp(lgamma({a} + {b} + n) - lgamma({b}) - lgamma({a} + n + 1) + ({a} + n) * ln({x}) + ({b}) * ln(1 - ({x}))))) END)"


def student_sql(t: str, df: str) -> str:
    """The probability of a t that is nearer to 0."""
    return beta_sql("0.5", f"(({df}) / 2.0)", f"(({t}) * ({t}) / (({df}) + ({t}) * ({t})))")
