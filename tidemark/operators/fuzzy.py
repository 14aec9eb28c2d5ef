"""Fuzzy inference over rows: a table of rules, memberships as column expressions, Mamdani's and Sugeno's conclusions."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of an output's range; a centroid takes Simpson's rule over each.
STEPS = 50


def _between(x, a, b):
    """0 up to a, 1 from b, a straight line between; a jump where they are one."""
    return F.when(x >= b, 1.0).when(x <= a, 0.0).otherwise((x - a) / (b - a) if b != a else F.lit(0.0))


def _s(x, a, b):
    u = (x - a) / (b - a)
    return F.when(x <= a, 0.0).when(x <= (a + b) / 2, 2 * u * u).when(x < b, 1 - 2 * (1 - u) * (1 - u)).otherwise(1.0)


def _sigmoid(x, slope, centre):
    return 1 / (1 + F.exp(-slope * (x - centre)))


def _normal(x, mean, deviation):
    return F.exp(-(x - mean) * (x - mean) / (2 * deviation * deviation))


#: Shapes and their parameters, in order.
SHAPES = {
    "constant": lambda x, v: F.when(x.isNotNull(), F.lit(v)),
    "triangle": lambda x, a, b, c: F.when(x <= b, _between(x, a, b)).otherwise(1 - _between(x, b, c)),
    "trapezoid": lambda x, a, b, c, d: F.when(x < b, _between(x, a, b)).when(x <= c, 1.0).otherwise(1 - _between(x, c, d)),
    "normal": _normal,
    "two_normals": lambda x, a, s, b, t: F.when(x < a, _normal(x, a, s)).when(x > b, _normal(x, b, t)).otherwise(1.0),
    "bell": lambda x, centre, power, width: 1 / (1 + F.pow(F.abs((x - centre) / width), F.lit(2.0 * power))),
    "s": _s,
    "z": lambda x, a, b: 1 - _s(x, a, b),
    "p": lambda x, a, b, c, d: F.when(x <= c, _s(x, a, b)).otherwise(1 - _s(x, c, d)),
    "sigmoid": _sigmoid,
    "two_sigmoids": lambda x, a, c, b, d: _sigmoid(x, a, c) * _sigmoid(x, b, d),
    "sigmoid_difference": lambda x, a, c, b, d: _sigmoid(x, a, c) - _sigmoid(x, b, d),
}


@dataclass(frozen=True)
class Rule:
    """If all (or any) of `when` hold, then `then`: a term of the output, or (constant, {variable: factor})."""

    when: tuple[tuple[str, str], ...]
    then: str | tuple[float, dict[str, float]]
    any: bool = False
    weight: float = 1.0


def membership(terms: dict[str, tuple], x: Column, name: str) -> Column:
    shape, *parameters = terms[name]
    return SHAPES[shape](x, *[float(p) for p in parameters])


def rules_of(table: DataFrame) -> list[Rule]:
    """Rules from a table of rule, variable, term, any_of, conclusion, weight: a row a condition. The table is a
    program, written by hand; it comes to the driver."""
    made: dict = {}
    for r in table.orderBy("rule", "variable", "term").collect():
        made.setdefault(r["rule"], []).append(r)
    return [Rule(tuple((r["variable"], r["term"]) for r in rs), rs[0]["conclusion"], bool(rs[0]["any_of"]), float(rs[0]["weight"])) for _, rs in sorted(made.items())]


def strength(rule: Rule, inputs: dict[str, dict]) -> Column:
    """How far a rule holds: the least of its conditions (the greatest if any will do) times its weight."""
    each = [membership(inputs[v], F.col(v).cast("double"), t) for v, t in rule.when]
    together = each[0] if len(each) == 1 else (F.greatest if rule.any else F.least)(*each)
    known = reduce(lambda a, b: a & b, [F.col(v).isNotNull() for v, _ in rule.when])
    return F.when(known, together * rule.weight)


def mamdani(df: DataFrame, inputs: dict[str, dict], output: dict[str, tuple], low: float, high: float, rules: list[Rule], out: str) -> DataFrame:
    """df with the centre of gravity of what the rules conclude.

    inputs: variable -> term -> (shape, parameters); output: the terms of the answer, over low to high.
    Each term is cut off at the strongest rule that concludes it, the union of all is their maximum,
    and its centroid is taken by Simpson's rule over STEPS steps. Null if an input of some rule is
    null, or if no rule holds at all.
    """
    h = (high - low) / (2 * STEPS)
    names = [t for t in output if any(r.then == t for r in rules)]
    x = F.lit(float(low)) + F.lit(h) * F.col("id")
    grid = df.sparkSession.range(2 * STEPS + 1).select("id", x.alias("x"), *[membership(output, x, t).alias(f"t{k}") for k, t in enumerate(names)]).orderBy("id").collect()
    listed = lambda values: F.from_json(F.lit(json.dumps(values)), "array<double>")
    weights = [1.0] + [4.0 if k % 2 else 2.0 for k in range(1, 2 * STEPS)] + [1.0]
    strengths = F.struct(*[_strongest([strength(r, inputs) for r in rules if r.then == t]).alias(f"s{k}") for k, t in enumerate(names)])

    def area(s: Column) -> Column:
        cuts = [_cut(listed([r[f"t{k}"] for r in grid]), s[f"s{k}"]) for k in range(len(names))]
        union = reduce(lambda u, c: F.zip_with(u, c, lambda a, b: F.greatest(a, b)), cuts)
        known = reduce(lambda a, b: a & b, [s[f"s{k}"].isNotNull() for k in range(len(names))])
        return F.when(known, F.zip_with(union, listed(weights), lambda u, w: u * w))

    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    moment = lambda a: total(F.zip_with(a, listed([r["x"] for r in grid]), lambda u, x: u * x))
    # named once, or a rule would be judged anew for every point
    centre = lambda a: _let(total(a), lambda whole: F.when(whole > 0, moment(a) / whole))
    return df.withColumn(out, _let(strengths, lambda s: _let(area(s), centre)))


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _strongest(each: list[Column]) -> Column:
    known = reduce(lambda a, b: a & b, [e.isNotNull() for e in each])
    return F.when(known, F.greatest(*each) if len(each) > 1 else each[0])


def _cut(shape: Column, at: Column) -> Column:
    return F.transform(shape, lambda v: F.least(v, at))


def sugeno(df: DataFrame, inputs: dict[str, dict], rules: list[Rule], out: str) -> DataFrame:
    """df with the rules' linear answers, each weighed by how far its rule holds; null as in `mamdani`."""
    made = [(strength(r, inputs), sum((F.col(v).cast("double") * f for v, f in r.then[1].items()), F.lit(float(r.then[0])))) for r in rules]
    whole = sum((s for s, _ in made[1:]), made[0][0])
    moment = sum((s * z for s, z in made[1:]), made[0][0] * made[0][1])
    return df.withColumn(out, F.when(whole > 0, moment / whole))
