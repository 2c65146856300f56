"""Planar queries on point columns. Rows whose value is no point never match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.points import coordinates, distance2

EPSILON = 1e-9
#: Names of a point's coordinates in an index, and bits of each on the curve.
X, Y, BITS = "_x of point", "_y of point", 16


def _xy(df: DataFrame, column: str) -> tuple[Column, Column]:
    """A point's coordinates; those that an index has as columns, which scans prune by, or else read from the column."""
    return (df[f"`{X}`"], df[f"`{Y}`"]) if X in df.columns else coordinates(df, column)


def with_place(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(X, T.DoubleType()), T.StructField(Y, T.DoubleType())])


def in_z_order(df: DataFrame, column: str) -> DataFrame:
    """The rows with their coordinates, sorted along a Z-order curve over the box of all points; what is no point comes first."""
    x, y = coordinates(df, column)
    df = df.withColumns({X: x, Y: y})
    box = df.agg(*(f(f"`{c}`").alias(f"{n}{i}") for i, c in enumerate((X, Y)) for n, f in (("lo", F.min), ("hi", F.max)))).first()

    def spread(c: str, lo: float | None, hi: float | None) -> Column:
        """Where between lo and hi, with a zero between every two bits."""
        wide = (hi - lo) if lo is not None and hi > lo else 1.0
        v = F.least(F.floor((F.col(f"`{c}`") - F.lit(lo or 0.0)) / F.lit(wide) * F.lit(float(1 << BITS))), F.lit((1 << BITS) - 1)).cast("long")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    z = spread(X, box["lo0"], box["hi0"]) + 2 * spread(Y, box["lo1"], box["hi1"])
    return df.withColumn("_z", z).repartitionByRange("_z").sortWithinPartitions("_z").drop("_z")


def _window(df: DataFrame, column: str, x0: float, y0: float, x1: float, y1: float):
    x, y = _xy(df, column)
    return x.between(float(min(x0, x1)), float(max(x0, x1))) & y.between(float(min(y0, y1)), float(max(y0, y1)))


def within_circle(df: DataFrame, column: str, px: float, py: float, radius: float) -> DataFrame:
    """Points at most `radius` away. The bounding box comes first: on struct columns the scan prunes by it."""
    x, y = _xy(df, column)
    return df.where(_window(df, column, px - radius, py - radius, px + radius, py + radius) & (distance2(x, y, px, py) <= float(radius) ** 2))


def within_window(df: DataFrame, column: str, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Points in a closed rectangle."""
    return df.where(_window(df, column, x0, y0, x1, y1))


def at_point(df: DataFrame, column: str, px: float, py: float, epsilon: float = EPSILON) -> DataFrame:
    return within_window(df, column, px - epsilon, py - epsilon, px + epsilon, py + epsilon)


def distance_to(df: DataFrame, column: str, px: float, py: float) -> Column:
    x, y = coordinates(df, column)
    return F.sqrt(distance2(x, y, px, py))


def nearest(df: DataFrame, column: str, px: float, py: float, k: int, key: str) -> DataFrame:
    """The k nearest points, exactly, ties by key; with `distance`. A top-k per task, then one merge; no full sort."""
    near = df.withColumn("distance", distance_to(df, column, px, py)).where(F.col("distance").isNotNull())
    return near.orderBy("distance", key).limit(k)
