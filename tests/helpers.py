"""What tests share."""

import os
from pathlib import Path

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def plain(v):
    """A value that compares alike whichever engine it comes from."""
    if v is None or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return f"{float(v):.6g}"
    return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)


def same_rows(df, relation) -> None:
    """A Spark frame and a DuckDB relation hold the same columns and rows, in any order."""
    a, b = df.toPandas(), relation.df()
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    rows = lambda x: sorted(tuple(map(plain, r)) for r in x[names].astype(object).itertuples(index=False))
    assert rows(a) == rows(b)
