"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the keys are cut into equal ranges, the cells, of about
CELL documents, so a source of any size spreads over many tasks. Sums per cell, and running sums over a source's
cells, show in which cell the budget ends. Cells before it are taken once more than cells after it; only the
documents of that one cell are sorted, and the document on which the budget ends is cut at its exact word.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.scratch import stash
from marlstone.llm.text import words

WEIGHTS = (3, 1, 2)
#: Words to take, in hundredths of all there are; most epochs of a source; documents per cell.
SHARE, EPOCHS, CELL = 150, 2, 4096


@F.arrow_udf(T.LongType())
def count_words(text: pa.Array) -> pa.Array:
    """Words of texts given as binary; bytes.split() cuts at the six ASCII spaces exactly."""
    return pa.array([len(x.split()) if x else 0 for x in text.to_pylist()], pa.int64())


def size_of(text: Column) -> Column:
    return count_words(text.cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """From (source, size, n): source, source_size, n, target. One row per source is all that this ever sorts.

    Weights go round the sources by code point, null last. A source below its weighted share's level gets
    `epochs` times its size; walking up the sources by size per weight, the first that isn't capped gives the
    level for the rest, which is where resharing the excess over and over ends.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n")).select("*", weight.cast("long").alias("w"))
    up = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    everything = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda c: F.sum(c).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(c)
    left = F.sum("source_size").over(everything) * (share / 100) - epochs * before("source_size")
    t = t.select("*", (left / (F.sum("w").over(everything) - before("w"))).alias("level"))
    t = t.select("*", (F.col("level") * F.col("w") >= epochs * F.col("source_size")).alias("capped"))
    # the first that isn't capped has the lowest size per weight; levels of later ones are not used
    first = F.min(F.when(~F.col("capped"), F.struct((F.col("source_size") / F.col("w")).alias("r"), "level"))).over(everything)["level"]
    target = F.when(F.col("capped"), (epochs * F.col("source_size")).cast("double")).otherwise(first * F.col("w"))
    return t.select("source", "source_size", "n", target.alias("target"))


def _key(doc_id: Column, seed: int) -> Column:
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")).cast("binary")), 1, 16)


def _cell(key: Column, n: Column) -> Column:
    """The range of keys, of as many as hold CELL documents each, that a key is in."""
    high = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return F.floor(high * F.ceil(n / CELL) / F.lit(2**32)).cast("long")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, epochs: int = EPOCHS, seed: int = 0) -> DataFrame:
    """The input rows and columns with _size, _source_size, _target and _taken: words the mix takes of each, repeats counted.

    Null and empty texts have size 0 and nothing is taken of them. Null sources are one source, the last. Rows
    that repeat are taken like different ones; null keys sort first. Empty input gives no rows.
    """
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # safe from names that clash with ours
    name = dict(zip(docs.columns, plain.columns, strict=True))
    sized = plain.select("*", size_of(plain[name[text]]).alias("_size"), _key(plain[name[key]], seed).alias("_key"))
    narrow = stash(sized.select(F.col(name[source]).alias("source"), F.col("_size").alias("size"), F.col("_key").alias("key")), "sizes")
    goal = targets(narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).select("source", "size", "n"), weights, share, epochs)
    budget = F.floor("target").cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    goal = stash(goal.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("n").alias("_n"), F.floor(budget / size).cast("long").alias("_epochs"), (budget % size).alias("_rest")), "targets")

    cells = narrow.join(goal, narrow["source"].eqNullSafe(goal["_s"])).select("_s", "_rest", "size", _cell(F.col("key"), F.col("_n")).alias("cell"))
    sums = cells.groupBy("_s", "_rest", "cell").agg(F.sum("size").alias("size"))
    run = sums.select("*", (F.sum("size").over(Window.partitionBy("_s").orderBy("cell")) - F.col("size")).alias("before"))
    ends = run.where(F.col("before") <= F.col("_rest")).groupBy("_s").agg(F.max(F.struct("cell", "before")).alias("x"))
    cut = goal.join(ends.select(F.col("_s").alias("_t"), F.col("x.cell").alias("_cut"), F.col("x.before").alias("_before")), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    cut = stash(cut, "cuts")

    wide = sized.join(cut, sized[name[source]].eqNullSafe(cut["_s"])).select("*", _cell(F.col("_key"), F.col("_n")).alias("_cell"))
    done = F.col("_epochs") * F.col("_size")
    whole = wide.where(F.col("_cell") != F.col("_cut")).select(*plain.columns, "_size", "_source_size", "_target", F.when(F.col("_cell") < F.col("_cut"), done + F.col("_size")).otherwise(done).alias("_taken"))
    order = Window.partitionBy("_s", "_cell").orderBy("_key", name[key], "_size", F.xxhash64(name[text])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("_before") + F.sum("_size").over(order) - F.col("_size")
    part = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - before))
    at_cut = wide.where(F.col("_cell") == F.col("_cut")).select(*plain.columns, "_size", "_source_size", "_target", (done + part).alias("_taken"))
    return whole.unionByName(at_cut).toDF(*docs.columns, "_size", "_source_size", "_target", "_taken")


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, the last time up to its last word taken.

    Rows of which nothing is taken go, empty texts with them. A document on which a budget ends comes as its
    first words joined by a space.
    """
    out = mix(docs, text=text, **options)
    n = out.columns[:-4]
    times = F.ceil(F.col("_taken") / F.greatest(F.col("_size"), F.lit(1))).cast("int")
    copies = out.where(F.col("_taken") > 0).select("*", F.explode(F.sequence(F.lit(1), times)).alias("_copy"))
    left = (F.col("_taken") - (F.col("_copy") - 1) * F.col("_size")).cast("int")
    short = F.array_join(F.slice(words(F.col(text)), F.lit(1), left), " ")
    return copies.select(*(F.when(left < F.col("_size"), short).otherwise(F.col(c)).alias(c) if c == text else c for c in n))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, substr(md5('0:' || CAST(doc_id AS VARCHAR)), 1, 16) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
u AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - 2 * coalesce(sum(source_size) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, level * w >= 2 * source_size AS capped FROM u),
t AS (SELECT source, source_size, CAST(CASE WHEN capped THEN 2 * source_size ELSE w * (SELECT level FROM c WHERE NOT capped ORDER BY source_size / w LIMIT 1) END AS DOUBLE) AS target FROM c),
r AS (SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) // greatest(source_size, 1) AS e, CAST(floor(target) AS BIGINT) % greatest(source_size, 1) AS rest,
  sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(e * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM r"""
