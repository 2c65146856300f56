"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _number(x: float) -> str:
    return f"double({float(x)!r})" if x == x and abs(x) != float("inf") else f"double('{float(x)}')"


def literal(v: list[float]) -> str:
    """SQL of a constant vector, not an empty one."""
    return f"array({', '.join(map(_number, v))})"


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; null where the lengths differ."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0)))


def cosine_to(column: str, query: list[float]) -> Column:
    """Cosine of a column to a fixed vector, whose norm is computed once, here. As SQL, which is one call to the JVM however long the vector."""
    n = sum(float(x) ** 2 for x in query) ** 0.5
    if n == 0:
        return F.lit(0.0)
    c = f"`{column}`"
    size = f"sqrt(aggregate({c}, double(0), (s, x) -> s + double(x) * double(x)))"
    dot = f"aggregate(zip_with({c}, {literal(query)}, (x, y) -> double(x) * y), double(0), (s, x) -> s + x)"
    return F.expr(f"CASE WHEN size({c}) = {len(query)} THEN CASE WHEN {size} > 0 THEN {dot} / ({size} * {_number(n)}) ELSE double(0) END END")


def parse_vector(c: Column) -> Column:
    """A vector from JSON text; null if it isn't one, or empty."""
    v = F.from_json(F.btrim(c), "array<double>")
    return F.when(F.size(v) > 0, v)
