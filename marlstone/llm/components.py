"""Connected components of a graph that is given as rows of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.scratch import drop, stash


def _moved(rows: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """rows with column's nodes replaced by what `to` (v, p) has for them."""
    t = to.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
    return rows.join(t, rows[column] == t["_v"], "left").withColumn(column, F.coalesce("_p", column)).drop("_v", "_p")


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of longs: node, root for every node of an edge, root the least node of its component.

    Each round hangs every node under its least neighbour, follows these pointers to their ends by doubling, and
    contracts the graph to the ends. Minima are combined before they are shuffled, so a node with very many edges
    costs one row per task; joins on it are between plain shuffles, which adaptive execution splits.
    """
    e = stash(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = stash(e.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), "nodes")
    while not e.isEmpty():
        both = e.select(F.col("a").alias("v"), F.col("b").alias("u")).unionAll(e.select(F.col("b").alias("v"), F.col("a").alias("u")))
        up = held = stash(both.groupBy("v").agg(F.min("u").alias("p")).select("v", F.least("v", "p").alias("p")), "up")
        while True:
            on = stash(_moved(up.withColumn("q", F.col("p")), "q", up), "jump")
            drop(held)
            up, held = on.select("v", F.col("q").alias("p")), on
            if on.where(F.col("p") != F.col("q")).isEmpty():
                break
        before = found
        found = stash(_moved(found, "root", up), "found")
        moved = _moved(_moved(e, "a", up), "b", up).where(F.col("a") != F.col("b"))
        last, e = e, stash(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        drop(before, last, held)
    drop(e)
    return found
