"""Removal of lines that many sites share.

A line's spread is the number of sites it stands on. One pass over the lines builds a HyperLogLog sketch of sites
per line hash; sketches of a task are merged before they are shuffled, so a line that a third of all documents have
costs one row per task, and a rare line's sketch is a short list. Lines whose estimate is within `band` of the
threshold get exact distinct counts from a second pass over the lines, which only their sites are shuffled for;
beyond the band the sketch decides. A boilerplate line stays in the document with the least id that has it and goes
from all others.

All of it is built-in functions. Rows carry 64-bit hashes, not lines: a line is taken for a given one of another
text with a chance of 2^-64, so among 10^12 different lines and a million of boilerplate some 0.05 are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.scratch import stash
from marlstone.llm.text import SPACES

#: Sites from which on a line is boilerplate, and registers of a sketch as a power of two.
MIN_SITES, LG_REGISTERS = 10, 10
#: The most bytes of lists of removed lines that are broadcast, as rows and their hash table take them; more are joined by a shuffle.
BROADCAST = 64 << 20


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def _lines(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """A row for each line that isn't blank: its hash and what to keep."""
    line = F.explode(F.split(F.coalesce(docs[text], F.lit("")), "\n"))
    return docs.select(*keep, line.alias("_line")).where(_bare(F.col("_line")) != "").withColumn("h", F.xxhash64(_bare(F.col("_line")))).drop("_line")


def band(min_sites: int, lg_registers: int = LG_REGISTERS) -> float:
    """How far an estimate may be off: six standard errors, and one."""
    return 1 + 6 * 1.04 / 2 ** (lg_registers / 2) * min_sites


def boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """Rows h, first: hashes of lines on min_sites sites or more and the least id of a document with each."""
    rows = _lines(docs, text, docs[key].alias("id"), F.xxhash64(docs[site]).alias("s"))
    seen = rows.groupBy("h").agg(F.hll_sketch_agg("s", F.lit(lg_registers)).alias("k"), F.min("id").alias("first"))
    off = band(min_sites, lg_registers)
    seen = stash(seen.select("h", "first", F.hll_sketch_estimate("k").alias("n")).where(F.col("n") >= min_sites - off), "estimates")
    near = seen.where(F.col("n") <= min_sites + off)
    exact = rows.join(near.select("h"), "h", "left_semi").groupBy("h").agg(F.countDistinct("s").alias("n")).where(F.col("n") >= min_sites)
    sure = seen.where(F.col("n") > min_sites + off).select("h", "first")
    return stash(sure.unionByName(near.select("h", "first").join(exact.select("h"), "h", "left_semi")), "boilerplate")


def without_boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """The input rows and columns, text without boilerplate lines, with _n_lines and _n_removed (lines that aren't blank).

    Lines are compared without white space around them, by 64-bit hashes; blank ones are left alone. Null sites are
    one site. A null id is larger than any other, and lines that only rows with null ids have stay. Rows with one id
    are alike: a line goes from all of them or from none. Null text stays null. No rows give no rows.
    """
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # safe from names that clash with ours
    name = dict(zip(docs.columns, plain.columns, strict=True))
    i, t = name[key], name[text]
    found = boilerplate(plain, i, t, name[site], min_sites, lg_registers)
    hits = _lines(plain, t, plain[i].alias("id")).join(found, "h").where(F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first"))))
    gone = stash(hits.groupBy("id").agg(F.collect_set("h").alias("_gone")).withColumnRenamed("id", "_id"), "gone")
    size = gone.agg(F.sum(F.size("_gone") * 8 + 128)).first()[0] or 0
    x = plain.join(F.broadcast(gone) if size <= BROADCAST else gone, plain[i].eqNullSafe(gone["_id"]), "left")
    split = F.split(F.coalesce(t, F.lit("")), "\n")
    full = lambda a: F.size(F.filter(a, lambda y: _bare(y) != ""))
    stays = F.filter(split, lambda y: (_bare(y) == "") | ~F.array_contains("_gone", F.xxhash64(_bare(y))))
    x = x.withColumn("_left", F.when(F.col("_gone").isNotNull(), F.array_join(stays, "\n")).otherwise(F.col(t)))
    n, m = full(split), full(F.split(F.coalesce("_left", F.lit("")), "\n"))
    columns = [F.col("_left").alias(c) if c == t else F.col(c) for c in plain.columns]
    return x.select(*columns, n.cast("long"), (n - m).cast("long")).toDF(*docs.columns, "_n_lines", "_n_removed")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = without_boilerplate(docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH l AS (SELECT doc_id, source, p, x AS line, trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents)),
b AS (SELECT bare, min(doc_id) AS first FROM l WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT coalesce(source, '<none>')) >= {MIN_SITES}),
m AS (SELECT l.*, coalesce(l.doc_id > b.first, FALSE) AS gone FROM l LEFT JOIN b ON l.bare = b.bare)
SELECT doc_id, CAST(count(*) FILTER (bare <> '') AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""
