"""Selection and projection as lazy frames; Catalyst pushes both to the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMPARE = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<>": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
}


def _kind(v: object) -> str:
    return "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "text" if isinstance(v, str) else "other"


def _column_kind(t: T.DataType) -> str:
    return "bool" if isinstance(t, T.BooleanType) else "number" if isinstance(t, T.NumericType) else "text" if isinstance(t, T.StringType) else "other"


def comparable(df: DataFrame, column: str, value: object) -> bool:
    """Whether values of such kinds can be compared; text never equals a number. Dates compare with text that Spark can read as such."""
    a, b = _column_kind(df.schema[column].dataType), _kind(value)
    return value is not None and (a == b or a == "other")


def compare(df: DataFrame, column: str, op: str, value: object) -> Column:
    """A comparison with a constant. Equality of different kinds is false, as is any comparison with NULL; ordering them is an error."""
    if value is None:
        return F.lit(False)
    if not comparable(df, column, value):
        if op == "=":
            return F.lit(False)
        if op in ("!=", "<>"):
            return F.col(f"`{column}`").isNotNull()
        raise TypeError(f"{column} can't be ordered against {value!r}")
    return _COMPARE[op](df[column], F.lit(value))


def between(df: DataFrame, column: str, low: object, high: object) -> Column:
    return compare(df, column, ">=", low) & compare(df, column, "<=", high)


def in_list(df: DataFrame, column: str, values: Iterable[object]) -> Column:
    usable = [v for v in values if comparable(df, column, v)]
    return df[column].isin(usable) if usable else F.lit(False)


def project(df: DataFrame, columns: list[str] | None, always: Iterable[str] = ()) -> DataFrame:
    """The columns in the order asked for, unknown ones as null; None for all. `always` are appended where they aren't among them."""
    if columns is None:
        return df
    known = {c.lower(): c for c in df.columns}
    want = [*columns, *(c for c in always if c.lower() not in {x.lower() for x in columns})]
    return df.select(*((df[known[c.lower()]] if c.lower() in known else F.lit(None).cast("string")).alias(c) for c in want))


def first_per_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    """Of rows with one key the first by `order`."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def new_keys(rows: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in base."""
    return rows.join(base.select(F.col(f"`{key}`")), key, "left_anti").select(*rows.columns)
