"""Two versions of a nested table compared field by field, by a plan that follows their schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a difference is.
DIFFERENCE = "array<struct<path:string,old:string,new:string,kind:string>>"


def _none() -> Column:
    return F.array().cast(DIFFERENCE)


def _one(path: Column, old: Column, new: Column, kind: str) -> Column:
    text = lambda x: x.cast("string")
    return F.array(F.struct(path.alias("path"), text(old).alias("old"), text(new).alias("new"), F.lit(kind).alias("kind"))).cast(DIFFERENCE)


def _seconds(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp")) / 1e6


def _near(kind: T.DataType, a: Column, b: Column, near: dict[str, float]) -> Column:
    """Whether two values that are there count as equal. NaN equals itself."""
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return a.eqNullSafe(b) | (F.abs(a.cast("double") - b.cast("double")) <= near.get("number", 0.0))
    if isinstance(kind, T.IntegralType):
        return F.abs(a.cast("decimal(20,0)") - b.cast("decimal(20,0)")) <= near.get("integer", 0)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.abs(_seconds(a) - _seconds(b)) <= near.get("seconds", 0.0)
    return a.eqNullSafe(b)


def _walk(kind: T.DataType, a: Column, b: Column, path: Column, near: dict[str, float]) -> Column:
    """The differences of two values of a type: both null are alike, one null is a difference of kind `null`."""
    if isinstance(kind, T.StructType):
        inner = F.concat(*[_walk(f.dataType, a[f.name], b[f.name], F.concat(path, F.lit(f".{f.name}")), near) for f in kind.fields]) if kind.fields else _none()
    elif isinstance(kind, T.ArrayType):
        both = F.greatest(F.size(a), F.size(b))

        def element(i: Column) -> Column:
            here = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
            x, y = F.get(a, i), F.get(b, i)
            deeper = _walk(kind.elementType, x, y, here, near)
            return F.when(i >= F.size(a), _one(here, F.lit(None), _text(y, kind.elementType), "added")).when(i >= F.size(b), _one(here, _text(x, kind.elementType), F.lit(None), "removed")).otherwise(deeper)

        inner = F.when(both > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(both - 1, F.lit(0))), element))).otherwise(_none())
    elif isinstance(kind, T.MapType):
        keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))

        def entry(k: Column) -> Column:
            here = F.concat(path, F.lit("{"), k.cast("string"), F.lit("}"))
            x, y = F.try_element_at(a, k), F.try_element_at(b, k)
            deeper = _walk(kind.valueType, x, y, here, near)
            return F.when(~F.map_contains_key(a, k), _one(here, F.lit(None), _text(y, kind.valueType), "added")).when(~F.map_contains_key(b, k), _one(here, _text(x, kind.valueType), F.lit(None), "removed")).otherwise(deeper)

        inner = F.flatten(F.transform(keys, entry))
    else:
        inner = F.when(_near(kind, a, b, near), _none()).otherwise(_one(path, a, b, "value"))
    nulls = _one(path, _text(a, kind), _text(b, kind), "null")
    return F.when(a.isNull() & b.isNull(), _none()).when(a.isNull() | b.isNull(), nulls).otherwise(inner)


def _text(x: Column, kind: T.DataType) -> Column:
    """A value as text; nested ones as JSON."""
    return F.to_json(x) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else x.cast("string")


def differences(old: DataFrame, new: DataFrame, keys: list[str], near: dict[str, float] | None = None) -> DataFrame:
    """keys, path, old, new, kind: every place where two versions of a table differ.

    Rows meet by their keys (null keys alike; keys are unique in each version). kind is `value`, `null` (one of the two is null),
    `added` or `removed` (a row, an array's element, a map's entry). near: how far values of a type may lie apart and
    still be equal: `number`, `integer`, `seconds`. Columns are those of both versions; one that a version lacks is null
    there; a column of two types is compared as text.
    """
    near = near or {}
    kinds, others = {f.name: f.dataType for f in old.schema}, {f.name: f.dataType for f in new.schema}
    names = [n for n in [*kinds, *[m for m in others if m not in kinds]] if n not in keys]

    def side(d: DataFrame, own: dict, label: str) -> DataFrame:
        cols = []
        for n in names:
            mixed = n in kinds and n in others and kinds[n] != others[n]
            x = F.col(n) if n in own else F.lit(None).cast(kinds.get(n, others.get(n)))
            cols.append((_text(x, own[n]) if mixed else x).alias(n))
        return d.select(*[F.col(k).alias(f"_{label}{i}") for i, k in enumerate(keys)], F.struct(*cols).alias(label))

    a, b = side(old, kinds, "a"), side(new, others, "b")
    on = [F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(keys))]
    both = a.join(b, on, "full_outer")
    here = [F.coalesce(f"_a{i}", f"_b{i}").alias(k) for i, k in enumerate(keys)]
    parts = []
    for n in names:
        mixed = n in kinds and n in others and kinds[n] != others[n]
        parts.append(_walk(T.StringType() if mixed else kinds.get(n, others.get(n)), F.col("a")[n], F.col("b")[n], F.lit(n), near))
    rows = lambda x, y, kind: _one(F.lit(""), F.to_json(x) if x is not None else F.lit(None), F.to_json(y) if y is not None else F.lit(None), kind)
    found = F.when(F.col("a").isNull(), rows(None, F.col("b"), "added")).when(F.col("b").isNull(), rows(F.col("a"), None, "removed")).otherwise(F.concat(*parts) if parts else _none())
    return both.select(*here, F.explode(found).alias("_d")).select(*keys, "_d.*")
