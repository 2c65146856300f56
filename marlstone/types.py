"""SQL type names, and types inferred from CSV cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPARK_TYPES = {
    "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "SERIAL": T.IntegerType(), "SMALLINT": T.ShortType(), "BIGINT": T.LongType(),
    "FLOAT": T.FloatType(), "REAL": T.FloatType(), "DOUBLE": T.DoubleType(),
    "CHAR": T.StringType(), "VARCHAR": T.StringType(), "STRING": T.StringType(), "TEXT": T.StringType(),
    "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(),
    "DATE": T.StringType(), "DATETIME": T.StringType(), "TIMESTAMP": T.StringType(),
    "BLOB": T.BinaryType(), "BINARY": T.BinaryType(),
    "ARRAY": T.ArrayType(T.FloatType()), "VECTOR": T.ArrayType(T.FloatType()),
}

TRUE_WORDS, BOOL_WORDS = ("1", "true", "t", "yes", "y"), ("true", "false", "t", "f", "yes", "no", "y", "n")


def spark_type(name: str) -> T.DataType:
    """The Spark type of a SQL type name; ValueError for names that aren't known."""
    try:
        return SPARK_TYPES[name.upper()]
    except KeyError:
        raise ValueError(f"unknown type {name}") from None


def cell_kinds(c: Column) -> Column:
    """An aggregate: the kinds of a text column's cells that aren't empty, as SQL types."""
    v = F.btrim(c)
    whole = F.rlike(v, F.lit(r"^[-+]?\d+$"))
    small = F.abs(v.try_cast("decimal(38,0)")) < 2**31
    number = F.rlike(v, F.lit(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"))
    kind = F.when(whole, F.when(small, "INT").when(v.try_cast("long").isNotNull(), "BIGINT").otherwise("VARCHAR")).when(number, "DOUBLE").when(F.lower(v).isin(*BOOL_WORDS), "BOOL").otherwise("VARCHAR")
    return F.collect_set(F.when(v != "", kind))


def type_of_kinds(seen: set[str]) -> str:
    """VARCHAR as soon as one cell is neither number nor boolean word, or words and numbers are mixed, else the widest."""
    if "VARCHAR" in seen or ("BOOL" in seen and len(seen) > 1):
        return "VARCHAR"
    return next((kind for kind in ("DOUBLE", "BIGINT", "INT", "BOOL") if kind in seen), "VARCHAR")


def from_text(c: Column, kind: T.DataType) -> Column:
    """A CSV cell as a value of the type: stripped, empty is null, integers also from decimals, boolean words, arrays from JSON."""
    c = F.btrim(c)
    c = F.when(c != "", c)
    if isinstance(kind, T.BooleanType):
        return F.when(c.isNotNull(), F.lower(c).isin(*TRUE_WORDS))
    if isinstance(kind, (T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(c.try_cast(kind), c.try_cast("double").try_cast("long").try_cast(kind))
    if isinstance(kind, T.ArrayType):
        return F.from_json(c, kind)
    if isinstance(kind, T.BinaryType):
        return c.cast("binary")
    return c.try_cast(kind)


def as_declared(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of df cast to the schema in its order; missing ones are null; further ones go."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*((F.col(f"`{have[f.name.lower()]}`").cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def pad_vector(c: Column, n: int) -> Column:
    """A vector cut or filled with zeros to n single-precision components; null stays null."""
    return F.slice(F.concat(c.cast("array<float>"), F.array_repeat(F.lit(0.0).cast("float"), n)), 1, n)
