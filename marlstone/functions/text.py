"""Tokens and weights of text search."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9áéíóúüñ]+"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def query_tokens(text: str) -> list[str]:
    """The same for a query, in Python."""
    return re.findall(TOKEN, text.lower())


def term_counts(c: Column) -> Column:
    """Structs (term, tf) of a text's distinct tokens, counted within the row by runs of the sorted tokens."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        ends = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ((i == n) | (F.get(s, i) != F.get(s, i - 1))))
        return F.transform(F.array(ends), lambda e: F.transform(e, lambda at, k: F.struct(F.get(s, at - 1).alias("term"), (at - F.when(k > 0, F.get(e, k - 1)).otherwise(F.lit(0))).cast("long").alias("tf"))))[0]

    return F.transform(F.array(F.array_sort(tokens(c))), runs)[0]


def has_text(c: Column) -> Column:
    return F.length(F.btrim(c)) > 0


def text_idf(n: Column, df: Column) -> Column:
    return F.log10(n / df)


def image_idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1))


def smooth_idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1
