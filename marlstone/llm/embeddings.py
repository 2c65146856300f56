"""Exact near-duplicate join of embeddings by the pigeonhole principle on subspaces.

Equal vectors are one point with a weight, so copies cost nothing. Unit vectors with cosine >= c are at a squared
distance of at most 2 - 2c. The points are turned by a fixed rotation, so that no block of coordinates is special,
and cut into blocks of a few dimensions. If the squared distances of all blocks add up to at most the budget, one
block stays within its own share, in proportion to its dimensions. For each block a grid with cells as wide as the
square root of its share, on its first two coordinates, makes the range join: a point meets those of its own cell
and of four of the eight cells around it, so each pair once. A cell's points come in tiles of bounded size; a pair
of tiles is one task's unit of work, however many points lie in one place.

The range join gets a block's coordinates only, as one byte each and a scale, with the rounding added to the radius:
some 60 bytes for a point and unit of work. It returns the points that have a near one in the unit, not the pairs.
Only these get their whole vectors, are verified in double precision, and a pair is counted in the first block that
shows it. A unit of work returns link counts and a spanning forest of its links, both no larger than its points,
never the pairs. Counts are summed, forests joined to components.

Points spread evenly in all directions can't be told apart by a few coordinates: a block's range join then compares
most pairs. What is shuffled grows in proportion to the input up to some TILE points a cell (some 150,000 in all) and
with tiles a cell after that; the comparisons, some 16 multiplications for a pair and block, grow with the square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.components import components
from marlstone.llm.scratch import stash

#: Dimensions of a block, vectors of a tile at most (about), and the rotation's seed.
BLOCK, TILE, SEED = 16, 32_768, 7
#: Rows of distances that are computed at a time.
ROWS = 256
#: Own cell, and the half of the neighbours that comes after it.
OFFSETS = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """An orthogonal matrix, the same wherever it is computed: products of seeded reflections."""
    rng = np.random.Generator(np.random.PCG64(seed))
    q = np.eye(dims)
    for _ in range(dims):
        v = rng.standard_normal(dims)
        v /= np.sqrt((v * v).sum())
        q -= 2 * np.outer(q @ v, v)
    return q


def blocks_of(dims: int, block: int = BLOCK) -> list[tuple[int, int, float]]:
    """(from, to, share of the budget) of each block."""
    return [(a, min(dims, a + block), (min(dims, a + block) - a) / dims) for a in range(0, dims, block)]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by the largest component first, so that squares neither overflow nor vanish."""
    v = vectors / np.abs(vectors).max(axis=1)[:, None]
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _matrix(data: list[bytes], dims: int) -> np.ndarray:
    """Vectors sent in single or double precision."""
    if len({*map(len, data)}) == 1:
        return np.frombuffer(b"".join(data), np.float32 if len(data[0]) == 4 * dims else np.float64).reshape(-1, dims).astype(np.float64)
    out = np.empty((len(data), dims))
    for i, x in enumerate(data):
        out[i] = np.frombuffer(x, np.float32 if len(x) == 4 * dims else np.float64)
    return out


def _valid(batches):
    """Rows id, dims, vector of the vectors that can link; in single precision where that loses nothing."""
    for batch in batches:
        ids, dims, data = [], [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if v and None not in v:
                raw = np.array(v, np.float64)
                scale = np.abs(raw).max()
                if np.isfinite(scale) and scale > 0:
                    with np.errstate(over="ignore"):
                        short = raw.astype(np.float32)
                    ids.append(i)
                    dims.append(len(v))
                    data.append((short if (short == raw).all() else raw).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], names=["id", "dims", "vector"])


def _cells(cosine: float, block: int):
    """A row for each block of each point: point, dims, block, x, y, code."""

    def run(batches):
        for batch in batches:
            points, every, data = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for dims in np.unique(every).tolist():
                of = np.flatnonzero(every == dims)
                turned = unit(_matrix([data[i] for i in of], dims)) @ rotation(dims)
                for k, (a, b, share) in enumerate(blocks_of(dims, block)):
                    width = np.sqrt((2 - 2 * cosine) * share) + 1e-9
                    cell = np.floor(turned[:, a : a + 2] / width).astype(np.int32)
                    n = len(of)
                    y = cell[:, 1] if b - a > 1 else np.zeros(n, np.int32)
                    code = [x.tobytes() for x in _codes(turned[:, a:b])]
                    yield pa.RecordBatch.from_arrays([pa.array(points[of]), pa.array(np.full(n, dims, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(cell[:, 0]), pa.array(y), pa.array(code, pa.binary())], names=["point", "dims", "block", "x", "y", "code"])

    return run


def _codes(x: np.ndarray) -> np.ndarray:
    """Rows of bytes: the step as a float and the coordinates in steps, one byte each."""
    step = (np.abs(x).max(axis=1) / 127).astype(np.float32)
    step = np.where(step > 0, step, np.float32(1))
    q = np.clip(np.rint(x / step[:, None].astype(np.float64)), -127, 127).astype(np.int8)
    return np.hstack((step[:, None].view(np.uint8), q.view(np.uint8)))


def _decoded(codes: list[bytes]) -> tuple[np.ndarray, float]:
    """The coordinates, and how far off a row can be."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    step = raw[:, :4].copy().view(np.float32)
    low = raw[:, 4:].view(np.int8) * step
    return low, float(step.max()) * 0.505 * np.sqrt(low.shape[1]) + 1e-6


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def roots(self) -> np.ndarray:
        while not np.array_equal(self.up, above := self.up[self.up]):
            self.up = above
        return self.up

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _near(cosine: float, block: int):
    """The points of a unit of work that have one of the other side, or another if it has one side, within the block's share."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        spec = key[1].as_py()
        dims, k, alone = spec >> 21, (spec >> 1) & 0xFFFFF, spec & 1
        side = table.column("side").to_numpy()
        low, off = _decoded(table.column("code").to_pylist())
        left = np.flatnonzero(side == 0)
        right = left if alone else np.flatnonzero(side == 1)
        near = (np.sqrt((2 - 2 * cosine) * blocks_of(dims, block)[k][2]) + 2 * off) ** 2 + 1e-5  # and for 32-bit products
        left = left[np.argsort(low[left, 0], kind="stable")]  # so what is compared at a time is often out of reach as a whole
        right = left if alone else right[np.argsort(low[right, 0], kind="stable")]
        square, one = np.einsum("ij,ij->i", low, low)[:, None], np.ones((len(low), 1), np.float32)
        from_left, from_right = np.hstack((-2 * low, square, one))[left], np.hstack((low, one, square))[right].T.copy()  # their products are squared distances
        reach, at_left, at_right = np.sqrt(near), low[left, 0], low[right, 0]
        hit = np.zeros(len(low), bool)
        for at in range(0, len(left), ROWS):
            some = slice(at, at + ROWS)
            first = np.searchsorted(at_right, at_left[some][0] - reach, "left")
            last = np.searchsorted(at_right, at_left[some][-1] + reach, "right")
            for to in range(max(first, at) if alone else first, last, 8 * ROWS):
                other = slice(to, min(to + 8 * ROWS, last))
                i, j = np.divmod(np.flatnonzero(from_left[some] @ from_right[:, other] <= near), other.stop - other.start)
                if alone:
                    i, j = i[at + i < to + j], j[at + i < to + j]
                hit[left[at + i]] = True
                hit[right[to + j]] = True
        found = table.filter(pa.array(hit))
        return found.select(["point", "unit", "spec", "side"])

    return run


def _meet(cosine: float, block: int):
    """Links between the left and the right points of a unit of work, or among the left ones if there are no others."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        spec = key[1].as_py()
        dims, k, alone = spec >> 21, (spec >> 1) & 0xFFFFF, spec & 1
        ids, side = table.column("point").to_numpy(), table.column("side").to_numpy()
        order = np.lexsort((ids, side))
        ids, side = ids[order], side[order]
        weight = table.column("weight").to_numpy()[order]
        whole = unit(_matrix(table.column("vector").to_pylist(), dims)[order])
        turned = whole @ rotation(dims)
        left = np.flatnonzero(side == 0)
        right = left if alone else np.flatnonzero(side == 1)
        limit, slack = 2 - 2 * cosine, 1e-9
        parts = blocks_of(dims, block)
        a, b, share = parts[k]
        links, forest, edges = np.zeros(len(ids), np.int64), _Forest(len(ids)), []
        low = turned[:, a:b].astype(np.float32)
        square, one = np.einsum("ij,ij->i", low, low)[:, None], np.ones((len(low), 1), np.float32)
        from_left, from_right = np.hstack((-2 * low, square, one)), np.hstack((low, one, square)).T.copy()  # their products are squared distances
        near = limit * share + 1e-5  # for the rounding of 32-bit products; the exact check follows
        for at in range(0, len(left), ROWS):
            some = left[at : at + ROWS]
            for to in range(at if alone else 0, len(right), 8 * ROWS):
                other = right[to : to + 8 * ROWS]
                i, j = np.divmod(np.flatnonzero(from_left[some] @ from_right[:, other] <= near), len(other))
                i, j = some[i], other[j]
                if alone:
                    i, j = i[i < j], j[i < j]
                for c in range(0, len(i), 1 << 16):
                    p, q = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                    ok = np.einsum("ij,ij->i", whole[p], whole[q]) >= cosine
                    p, q = p[ok], q[ok]
                    d = (turned[p] - turned[q]) ** 2
                    first = d[:, a:b].sum(axis=1) <= limit * share + slack
                    for c0, c1, s in parts[:k]:
                        first &= d[:, c0:c1].sum(axis=1) > limit * s + slack
                    p, q = p[first], q[first]
                    links += np.bincount(p, weight[q], len(ids)).astype(np.int64) + np.bincount(q, weight[p], len(ids)).astype(np.int64)
                    root = forest.roots()
                    new = np.flatnonzero(root[p] != root[q])
                    for x, y in zip(p[new].tolist(), q[new].tolist(), strict=True):
                        if forest.join(x, y):
                            edges.append((x, y))
        some = np.flatnonzero(links)
        n = len(some)
        e = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table(
            {
                "point": pa.concat_arrays([pa.array(ids[some]), pa.nulls(len(e)).cast(pa.int64())]),
                "links": pa.concat_arrays([pa.array(links[some]), pa.nulls(len(e)).cast(pa.int64())]),
                "a": pa.concat_arrays([pa.nulls(n).cast(pa.int64()), pa.array(ids[e[:, 0]])]),
                "b": pa.concat_arrays([pa.nulls(n).cast(pa.int64()), pa.array(ids[e[:, 1]])]),
            }
        )

    return run


def _units(at: DataFrame, tile: int) -> DataFrame:
    """A row for each unit of work: unit, spec, and cell and tile of both of its sides (the same ones where it is alone)."""
    place = ["dims", "block", "x", "y"]
    counts = stash(at.groupBy(*place).agg(F.ceil(F.count("*") / tile).cast("int").alias("t")), "tiles")
    shift = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in OFFSETS))).alias("o")
    to = counts.select(F.col("dims").alias("d2"), F.col("block").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("t").alias("t2"))
    near = counts.select("*", shift)
    near = near.join(to, (F.col("dims") == F.col("d2")) & (F.col("block") == F.col("k2")) & (F.col("x") + F.col("o.dx") == F.col("x2")) & (F.col("y") + F.col("o.dy") == F.col("y2")))
    same = (F.col("o.dx") == 0) & (F.col("o.dy") == 0)
    tiles = near.select("*", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("i"))
    tiles = tiles.select(*place, "i", "x2", "y2", F.explode(F.sequence(F.when(same, F.col("i")).otherwise(F.lit(0)), F.col("t2") - 1)).alias("j"))
    alone = ((F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")) & (F.col("i") == F.col("j"))).cast("long")
    spec = F.col("dims").cast("long") * (1 << 21) + F.col("block") * 2 + alone
    return stash(tiles.select("*", spec.alias("spec"), F.monotonically_increasing_id().alias("unit")), "units")


def embedding_components(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """Rows vec_id, n_links, component_id, kept: one per input row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, vectors of different
    length don't link with each other, rows with a null key link with nothing and have no component. Keys should
    be unique; of rows that repeat a key only the vector with the least bytes is compared, and all get its result.
    Other columns are ignored. No rows give no rows.
    """
    plain = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("v"))
    valid = plain.where("id is not null").mapInArrow(_valid, "id long, dims int, vector binary")
    one = valid.groupBy("id").agg(F.min(F.struct("dims", "vector")).alias("s")).select("id", "s.dims", "s.vector")
    one = stash(one.select("*", F.xxhash64("dims", "vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("g")), "vectors")
    classes = stash(one.groupBy("h", "g").agg(F.min("id").alias("point"), F.count("*").alias("weight")), "classes")
    points = stash(one.join(classes, one["id"] == classes["point"]).select("point", "weight", "dims", "vector"), "points")
    at = stash(points.select("point", "dims", "vector").mapInArrow(_cells(cosine, block), "point long, dims int, block int, x int, y int, code binary"), "cells")
    units = _units(at, tile)
    place = ["dims", "block", "x", "y", "i"]
    t = units.groupBy(*place[:4]).agg((F.max("i") + 1).alias("t"))
    own = at.join(t, place[:4]).withColumn("i", F.pmod(F.xxhash64("point"), F.col("t")).cast("int")).drop("t")
    left = own.join(units, place).select("unit", "spec", "point", "code", F.lit(0).alias("side"))
    back = units.where(F.col("spec") % 2 == 0).select("dims", "block", F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("j").alias("i"), "unit", "spec")
    right = own.join(back, place).select("unit", "spec", "point", "code", F.lit(1).alias("side"))
    near = left.unionByName(right).groupBy("unit", "spec").applyInArrow(_near(cosine, block), "point long, unit long, spec long, side int")
    met = stash(near, "near").join(points.select("point", "weight", "vector"), "point")
    met = stash(met.groupBy("unit", "spec").applyInArrow(_meet(cosine, block), "point long, links long, a long, b long"), "met")
    links = met.where("point is not null").groupBy("point").agg(F.sum("links").alias("links"))
    root = components(met.where("a is not null").select("a", "b"))
    of = classes.join(links, "point", "left").join(root, F.col("point") == F.col("node"), "left")
    of = stash(of.select("h", "g", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "point").alias("root")), "results")
    known = one.select("id", "h", "g").join(of, ["h", "g"]).select(F.col("id").alias("_id"), "n_links", "root")
    out = plain.select(F.col("id").alias("vec_id")).join(known, F.col("vec_id") == F.col("_id"), "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: Small tables only: all pairs.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT v.vec_id, least(v.vec_id, min(r.b)) AS component_id FROM v LEFT JOIN r ON v.vec_id = r.a GROUP BY v.vec_id)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c"""
