"""CSV files with a header, as typed frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.types import cell_kinds, from_text, spark_type, type_of_kinds


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=False, escape='"', encoding="UTF-8")


def inferred_columns(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, SQL type) by all rows, one row of what occurs in each column coming to the driver."""
    raw = _raw(spark, path)
    seen = raw.agg(*(cell_kinds(raw[f"`{c}`"]).alias(str(i)) for i, c in enumerate(raw.columns))).first()
    return [(c.strip(), type_of_kinds(set(seen[i] or []))) for i, c in enumerate(raw.columns)]


def rejected(raw: DataFrame, schema: T.StructType) -> Column:
    """Of a raw row, how many cells aren't empty and can't be read as their column's type."""
    have = {c.strip().lower(): raw[f"`{c}`"] for c in raw.columns}
    bad = [F.when((F.btrim(have[f.name.lower()]) != "") & from_text(have[f.name.lower()], f.dataType).isNull(), 1).otherwise(0) for f in schema if f.name.lower() in have]
    return sum(bad, F.lit(0))


def count_rejected(spark: SparkSession, path: str, schema: T.StructType) -> int:
    raw = _raw(spark, path)
    return raw.agg(F.sum(rejected(raw, schema)).alias("n")).first()["n"] or 0


def typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns cast to the schema by name, in its order; missing ones are null."""
    have = {c.strip().lower(): c for c in raw.columns}
    lit = lambda f: raw[f"`{have[f.name.lower()]}`"] if f.name.lower() in have else None
    return raw.select(*((from_text(lit(f), f.dataType) if lit(f) is not None else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    schema = schema or T.StructType([T.StructField(c, spark_type(t)) for c, t in inferred_columns(spark, path)])
    return typed(_raw(spark, path), schema)
