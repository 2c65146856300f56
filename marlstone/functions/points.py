"""Planar points in columns: text as "[x, y]" or "x,y", arrays, or structs of x and y."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
TEXT_POINT = rf"^\s*\[?\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\]?\s*$"


def coordinates(df: DataFrame, column: str) -> tuple[Column, Column]:
    """x and y as doubles; null for what is no point."""
    kind, c = df.schema[column].dataType, df[column]
    if isinstance(kind, T.StructType):
        return c["x"].cast("double"), c["y"].cast("double")
    if isinstance(kind, T.ArrayType):
        return F.get(c, F.lit(0)).cast("double"), F.get(c, F.lit(1)).cast("double")
    part = lambda i: F.regexp_extract(c.cast("string"), TEXT_POINT, i).try_cast("double")
    return part(1), part(2)


def distance2(x: Column, y: Column, px: float, py: float) -> Column:
    return (x - F.lit(float(px))) * (x - F.lit(float(px))) + (y - F.lit(float(py))) * (y - F.lit(float(py)))


# ---- bounding boxes (min_x, min_y, max_x, max_y as columns) ----


def box_area(a: Column) -> Column:
    return (a["max_x"] - a["min_x"]) * (a["max_y"] - a["min_y"])


def box_expand(a: Column, b: Column) -> Column:
    low, high = (lambda k: F.least(a[k], b[k]).alias(k)), (lambda k: F.greatest(a[k], b[k]).alias(k))
    return F.struct(low("min_x"), low("min_y"), high("max_x"), high("max_y"))


def box_enlargement(a: Column, b: Column) -> Column:
    return box_area(box_expand(a, b)) - box_area(a)


def box_intersects(a: Column, b: Column) -> Column:
    return (a["min_x"] <= b["max_x"]) & (b["min_x"] <= a["max_x"]) & (a["min_y"] <= b["max_y"]) & (b["min_y"] <= a["max_y"])


def min_distance2(a: Column, px: float, py: float) -> Column:
    """Squared distance from a point to a box, 0 inside."""
    gap = lambda lo, hi, v: F.greatest(lo - v, F.lit(0.0), v - hi)
    dx, dy = gap(a["min_x"], a["max_x"], F.lit(float(px))), gap(a["min_y"], a["max_y"], F.lit(float(py)))
    return dx * dx + dy * dy
