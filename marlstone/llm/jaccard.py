"""Exact Jaccard join of documents on word n-grams, in the metric space of sets.

Equal sets are one point, a label. The distance is 1 - Jaccard; two points link within the radius r = 1 - t.

Who can see whom. Almost all distances in this space are 1, and no pivot tells points at distance 1 apart. So rare
n-grams come first: points within r of each other share an n-gram among the first n - ceil(t * n) + 1 of each, in any
order of n-grams that all use. The order here goes from rare to frequent, by a table of counts that grows with the
input up to a bound. For each such n-gram the least label that has it is a pivot, and all points that have it see this
pivot. Every two points that link see a common one. This decides only which points are looked at together; the rest
is metric.

Small regions. Points that see a pivot are its region. A region first compares sketches: counts of a set's n-grams in CELLS
buckets, whose L1 distance never exceeds the symmetric difference of the sets. Points without a possible partner
leave, mostly those which share a passage only. The others' sets are read from their texts and the region is solved
in one task (`solve`): its pivot links all within r; by the triangle inequality a point at distance d from the pivot
can only link to points from d - r to d + r, so only points that have points of another part of the region in this
window go on with the next pivot, recursively. N-grams that no other point of the region has are dropped before
each step, and points with too few left.

Large regions, of more than REGION points or SHINGLES n-grams (`voronoi`), are split by PIVOTS or so fresh pivots, drawn
by hash. The distances to them are exact, taken in buckets of bounded size. What is within r of a pivot is linked to
it, which joins a group of near copies at once, however large. Points whose nearest pivot is at most INSIDE away
belong to its cell (INSIDE: 1 - 2r), and all points are replicas in each cell whose pivot is at most 2r farther away than their own
nearest one, and at most INSIDE + r: if y links to x, whose nearest pivot is c at d(x,c) <= INSIDE, then d(y,c) <=
d(x,c) + r, and d(x,c) <= d(x,n) <= d(y,n) + r for y's nearest pivot n, so y is in the cell of c too. Points farther
than INSIDE from every pivot meet each other in a cell of their own. Pivots have met all and leave; what is all one
part needs no comparing. The work of a cell is the number of its pairs of different parts. Where cells have less in
all than the region without its pivots, they take its place, else it goes on whole, with pivots from its small parts.
Small cells are solved, large ones split again. Where neither takes a fifth from the work, as between points that are
all far from each other, pivots don't help; such a region is dealt to blocks, each pair of which is solved by itself.

Sets are compared by 64-bit hashes of n-grams and of whole sets; different ones agree with a chance of 2^-64.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.components import components
from marlstone.llm.hashing import in_batches, joined, mixed, summed, table_rows, word_hashes
from marlstone.llm.scratch import stash

#: Bits of the table of counts, one slot for some 80 n-grams between these bounds, and buckets of a sketch.
TABLE_BITS, CELLS = (16, 23), 256
#: The most points and n-grams of a region that one task solves; points of a bucket or block; pivots of a large region.
REGION, SHINGLES, BLOCK, PIVOTS = 512, 4_000_000, 512, 24
#: A distance from which on a point belongs to no pivot's cell, in radii below 1.
INSIDE = 2
#: The most ids of documents to be read again that are broadcast; more are joined by a shuffle.
BROADCAST = 1 << 20


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Hashes of the distinct n-grams of a text, A-Z in lower case; of all its words if it has fewer."""
    w = word_hashes((text or b"").lower().split())
    if len(w) == 0:
        return w
    if len(w) < words:
        h, n = w[:1], 1
        for i in range(1, len(w)):
            h, n = joined(h, w[i : i + 1], n), n + 1
        return mixed(h ^ np.uint64(n))
    h = w
    for n in range(1, words):
        h = joined(h[:-1], w[n:], n)
    return np.unique(mixed(h))


def label_of(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def _slot(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> np.uint64(64 - bits)).astype(np.int64)


def _digest(words: int, bits: int):
    """Rows of documents, and at the end of a task those of its table of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in in_batches(batches, 1024):
            sets = [shingles(x, words) for x in batch.column(1).to_pylist()]
            if (every := [s for s in sets if len(s)]) != []:
                counts = np.bincount(_slot(np.concatenate(every), bits), minlength=1 << bits)
                table = counts if table is None else table + counts
            none = pa.nulls(len(sets))
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([label_of(s) if len(s) else None for s in sets], pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "label", "slice", "counts"])
        if table is not None:
            rows = table_rows(table)
            none = pa.nulls(rows.num_rows).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, *rows.columns], names=["doc_id", "n", "label", "slice", "counts"])

    return run


def _sites(words: int, num: int, den: int, order: np.ndarray, bits: int):
    """Per label a row with its sketch, and one for each of its first n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in in_batches(batches):
            gs, of, labels, sizes, sketches = [], [], [], [], []
            for text in batch.column(0).to_pylist():
                s = shingles(text, words)
                if not len(s) or (label := label_of(s)) in done:
                    continue
                done.add(label)
                first = len(s) - -(-num * len(s) // den) + 1
                gs.append(s[np.argsort(order[_slot(s, bits)], kind="stable")[:first]])
                of.append(np.full(len(gs[-1]), label, np.int64))
                labels.append(label)
                sizes.append(len(s))
                sketches.append(np.minimum(np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes())
            if labels:
                g, x = np.concatenate(gs).view(np.int64), np.concatenate(of)
                a, b = len(labels), len(g)
                none = lambda n, t: pa.nulls(n).cast(t)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([none(a, pa.int64()), pa.array(g)]), pa.concat_arrays([pa.array(labels, pa.int64()), pa.array(x)]), pa.concat_arrays([pa.array(sizes, pa.int64()), none(b, pa.int64())]), pa.concat_arrays([pa.array(sketches, pa.binary()), none(b, pa.binary())])],
                    names=["g", "label", "n", "sketch"],
                )

    return run


def _near(n: np.ndarray, m: int, difference: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of n and m elements that differ in so many can have den * common >= num * union."""
    return difference * (den + num) <= (n + m) * (den - num)


def _hopeful(num: int, den: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        x = np.stack([np.frombuffer(s, np.uint8) for s in table.column("sketch").to_pylist()]).astype(np.int16)
        keep = np.zeros(len(n), bool)
        for i in range(len(n) - 1):
            near = _near(n[i + 1 :], int(n[i]), np.abs(x[i + 1 :] - x[i]).sum(axis=1, dtype=np.int64), num, den)
            keep[i + 1 :] |= near
            keep[i] |= near.any()
        return table.select(["p", "label", "n"]).filter(pa.array(keep))

    return run


def solve(sets: list[np.ndarray], num: int, den: int, parts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that join all sets that link directly or over others; exact. See the module on how. parts: numbers of what is joined already."""
    n = np.array([len(s) for s in sets], np.int64)
    value = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), n)
    value = np.unique(value, return_inverse=True)[1]
    here, part, links = np.ones(len(sets), bool), np.arange(len(sets)) if parts is None else parts.copy(), []
    r = 1 - num / den + 1e-9
    while True:
        while True:  # what nobody else here has can't be common
            keep = here[owner] & (np.bincount(value[here[owner]], minlength=int(value.max(initial=0)) + 1)[value] > 1)
            value, owner = value[keep], owner[keep]
            gone = here & (np.bincount(owner, minlength=len(sets)) * den < num * n)
            if not gone.any():
                break
            here &= ~gone
        parts, members = np.unique(part[here], return_counts=True)
        if len(parts) < 2:  # who is joined already needs no comparing
            return links
        pivot = int(np.flatnonzero(here & (part == parts[members.argmin()]))[0])
        mine = np.zeros(int(value.max(initial=0)) + 1, bool)
        mine[value[owner == pivot]] = True
        common = np.bincount(owner[mine[value]], minlength=len(sets))
        union = n + n[pivot] - common
        for i in np.flatnonzero(here & (common * den >= num * union)):
            if part[i] != part[pivot]:
                links.append((pivot, int(i)))
                part[part == part[i]] = part[pivot]
        here[pivot] = False  # it has met everyone
        at = np.flatnonzero(here)
        d = 1 - common[at] / union[at]
        order = np.argsort(d, kind="stable")
        at, d = at[order], d[order]
        run = np.cumsum(np.concatenate(([0], np.diff(part[at]) != 0))) if len(at) else at
        low, high = np.searchsorted(d, d - r, "left"), np.searchsorted(d, d + r, "right")
        here[at[run[low] == run[high - 1]]] = False  # only its own part within the window


def _solved(num: int, den: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        labels = table.column("label").to_pylist()
        parts = np.unique(table.column("part").to_numpy(), return_inverse=True)[1] if "part" in table.column_names else None
        links = solve([np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()], num, den, parts)
        return pa.table({"a": pa.array([labels[i] for i, _ in links], pa.int64()), "b": pa.array([labels[j] for _, j in links], pa.int64())})

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in in_batches(batches):
            rows = []
            for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingles(text, words)
                if label not in done and len(s) and label_of(s) == label:
                    done.add(label)
                    rows.append((label, s.tobytes()))
            if rows:
                a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.binary())], names=["label", "shingles"])

    return run


def distances(sets: list[np.ndarray], pivots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersections and unions of each set with each pivot."""
    grams, at = np.unique(np.concatenate(pivots), return_inverse=True)
    has = np.zeros((len(grams) + 1, len(pivots)), np.int32)  # the last row is for n-grams that no pivot has
    has[at, np.repeat(np.arange(len(pivots)), [len(p) for p in pivots])] = 1
    common = np.empty((len(sets), len(pivots)), np.int64)
    for i, s in enumerate(sets):
        slot = np.searchsorted(grams, s)
        slot[slot == len(grams)] = 0
        slot = np.where(grams[slot] == s, slot, len(grams))
        common[i] = has[slot].sum(axis=0)
    n, m = np.array([len(s) for s in sets]), np.array([len(p) for p in pivots])
    return common, n[:, None] + m[None, :] - common


_PLACED = "region long, label long, part long, pivot long, cell long, linked boolean"


def _placed(num: int, den: int):
    """Members of a bucket against the region's pivots: a row for each cell that a member belongs to and each pivot it links to."""

    def run(key: tuple[pa.Scalar, ...], members: pa.Table, pivots: pa.Table) -> pa.Table:
        none = pa.table({n: pa.array([], t) for n, t in (("region", pa.int64()), ("label", pa.int64()), ("part", pa.int64()), ("pivot", pa.int64()), ("cell", pa.int64()), ("linked", pa.bool_()))})
        if not members.num_rows or not pivots.num_rows:
            return none
        region, label, part = (members.column(c).to_numpy() for c in ("region", "label", "part"))
        chosen = np.argsort(pivots.column("label").to_numpy(), kind="stable")
        at = pivots.column("label").to_numpy()[chosen]
        shingles = pivots.column("shingles").to_pylist()
        common, union = distances([np.frombuffer(x, np.uint64) for x in members.column("shingles").to_pylist()], [np.frombuffer(shingles[i], np.uint64) for i in chosen])
        d = 1 - common / union
        linked = common * den >= num * union
        r, nearest = 1 - num / den, d.min(axis=1, keepdims=True)
        far = 1 - INSIDE * r
        inside = (d <= nearest + 2 * r + 1e-9) & (d <= far + r + 1e-9)
        away = nearest[:, 0] > far  # from every pivot: with each other as well
        met = np.isin(label, at)  # a pivot has met everyone
        inside[met], away[met] = False, False
        linked &= label[:, None] != at[None, :]
        i, j = np.nonzero(inside | linked)
        name = lambda region, pivot: mixed(region.astype(np.uint64) * np.uint64(3) ^ mixed(pivot.astype(np.uint64))).view(np.int64)
        cell = pa.array(name(region[i], at[j]), mask=~inside[i, j])
        k = np.flatnonzero(away)
        rest = pa.table({"region": region[k], "label": label[k], "part": part[k], "pivot": pa.nulls(len(k)).cast(pa.int64()), "cell": name(region[k], region[k] + 1), "linked": np.zeros(len(k), bool)})
        return pa.concat_tables([pa.table({"region": region[i], "label": label[i], "part": part[i], "pivot": at[j], "cell": cell, "linked": linked[i, j]}), rest])

    return run


def _blocks(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links of regions (region, label, part) that no pivot splits: every pair of blocks is solved."""
    count = stash(rows.groupBy("region").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k")), "blocks")
    x = rows.join(count, "region").select("*", F.pmod(F.xxhash64("label"), F.col("k")).cast("int").alias("i"))
    x = x.select("region", "label", "part", "i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j")).select("region", "label", "part", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return x.join(sets, "label").groupBy("region", "i", "j").applyInArrow(_solved(num, den), "a long, b long")


def _measured(rows: DataFrame, *by: str) -> DataFrame:
    """For each group of rows: c points, s n-grams, its largest part and that one's points, a label of its smallest part, and the pairs of different parts."""
    parts = rows.groupBy(*by, "part").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.min("label").alias("label"))
    c = F.col("c").cast("double")
    return parts.groupBy(*by).agg(F.sum("c").alias("c"), F.sum("n").alias("s"), F.max_by("part", F.struct("c", "part")).alias("big"), F.max("c").alias("most"), F.min_by("label", F.struct("c", "part")).alias("least"), (F.sum(c) * F.sum(c) - F.sum(c * c)).alias("work"))


def voronoi(rows: DataFrame, sets: DataFrame, num: int, den: int, region: int = REGION, max_shingles: int = SHINGLES, pivots: int = PIVOTS) -> DataFrame:
    """Links of regions (region, label) that are too large for a task; sets: label, shingles. See the module on how.

    A loop over splits; each takes a fifth from the work of what it goes on with at least, and is materialised.
    """
    labels = stash(rows.select("label").distinct(), "labels")
    few = F.broadcast(labels) if labels.count() <= BROADCAST else labels
    sets = stash(sets.join(few, "label", "left_semi"), "sets")  # those of large regions alone
    size = stash(sets.select("label", (F.length("shingles") / 8).cast("long").alias("n")), "sizes")
    rows = stash(rows.select("region", "label", F.col("label").alias("part")).join(size, "label"), "large")
    edges = None
    for turn in itertools.count():
        regions = stash(_measured(rows, "region"), "regions")
        eligible, pool = (F.col("part") != F.col("big")) | (F.col("most") == 1), F.when(F.col("most") == 1, F.col("c")).otherwise(F.col("c") - F.col("most"))
        draw = eligible & (F.pmod(F.xxhash64("label", "region", F.lit(turn)), F.lit(1 << 30)) * pool < pivots * (1 << 30))
        bucket = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("s") / max_shingles)).cast("int")
        x = rows.join(regions, "region").select("region", "label", "part", "n", (draw | (F.col("label") == F.col("least"))).alias("pivot"), bucket.alias("k"))
        chosen = stash(x.where("pivot").select("region", "label", "part", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bucket")).join(sets, "label"), "pivots")
        members = x.select("region", "label", "part", F.pmod(F.xxhash64("label"), F.col("k")).cast("int").alias("bucket")).join(sets, "label")
        placed = stash(members.groupBy("region", "bucket").cogroup(chosen.groupBy("region", "bucket")).applyInArrow(_placed(num, den), _PLACED), "placed")
        linked = placed.where("linked")
        found = linked.select(F.col("label").alias("a"), F.col("pivot").alias("b"))
        edges = found if edges is None else edges.unionAll(found)
        at = chosen.where("bucket = 0").select("region", F.col("label").alias("pivot"), F.col("part").alias("b"))
        parts = components(linked.join(at, ["region", "pivot"]).select(F.col("part").alias("a"), "b"))

        def renamed(x: DataFrame) -> DataFrame:
            return x.join(parts, x["part"] == parts["node"], "left").withColumn("part", F.coalesce("root", "part")).drop("node", "root")  # noqa: B023

        whole = x.where("not pivot").select("region", F.col("region").alias("cell"), "label", "part", "n")
        cells = placed.where("cell is not null").select("region", "cell", "label", "part").join(size, "label").select(*whole.columns)
        going = stash(renamed(cells.unionAll(whole)), "going")
        todo = stash(_measured(going, "region", "cell").where("work > 0").withColumn("split", F.col("cell") != F.col("region")), "todo")
        work = todo.groupBy("region").agg(F.coalesce(F.sum(F.when(F.col("split"), F.col("work"))), F.lit(0)).alias("cells"), F.coalesce(F.sum(F.when(~F.col("split"), F.col("work"))), F.lit(0)).alias("whole"))
        work = work.join(regions.select("region", "work", F.col("c").alias("before")), "region")
        plan = stash(work.select("region", (F.col("cells") < F.col("whole")).alias("by_cells"), ((F.least("cells", "whole") > 0.8 * F.col("work")) & (F.col("before") > region)).alias("stuck")), "plan")
        todo = todo.join(plan, "region").where((F.col("split") == F.col("by_cells")) & ~F.col("stuck"))
        todo = stash(todo.select("region", "cell", ((F.col("c") <= region) & (F.col("s") <= max_shingles)).alias("small")), "cells")
        next_ = going.join(todo, ["region", "cell"])
        solved = stash(next_.where("small").select("cell", "label", "part").join(sets, "label").groupBy("cell").applyInArrow(_solved(num, den), "a long, b long"), "solved")
        edges = edges.unionAll(solved)
        stuck = plan.where("stuck")
        if not stuck.isEmpty():
            lost = going.where(F.col("cell") == F.col("region")).join(stuck, "region").select("region", "label", "part")
            edges = edges.unionAll(stash(_blocks(lost, sets, num, den), "blocked"))
        rows = stash(next_.where("not small").select(F.col("cell").alias("region"), "label", "part", "n"), "large")
        if rows.isEmpty():
            return edges


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: tuple[int, int] = (80, 100), region: int = REGION, max_shingles: int = SHINGLES) -> DataFrame:
    """Rows doc_id, n_shingles, component_id: one per input row; threshold: (80, 100) links from Jaccard 0.8 on.

    component_id is the least key reachable by links, itself included. Rows without words (null, empty, blank) have
    0 shingles and link with nothing. Rows with a null key are counted but link with nothing, component null.
    Rows that share a key count as one document for the component. Other columns are ignored.
    """
    num, den = threshold
    narrow = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("binary").alias("text"))
    letters = narrow.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = min(max(TABLE_BITS[0], (letters // 512).bit_length()), TABLE_BITS[1])
    first = stash(narrow.mapInArrow(_digest(words, bits), "doc_id long, n long, label long, slice int, counts binary"), "digests")
    counts = summed(first.where("slice is not null").select("slice", "counts"), 1 << bits)
    order = np.round(8 * np.log2(counts + 1)).astype(np.uint8)  # classes of frequency; n-grams of one class stand by hash
    rows = first.where("slice is null").select("doc_id", "n", "label")
    classes = stash(rows.where("label is not null and doc_id is not null").groupBy("label").agg(F.min("doc_id").alias("first"), F.max("n").alias("n")), "classes")

    prefix = stash(narrow.where("doc_id is not null").select("text").mapInArrow(_sites(words, num, den, order, bits), "g long, label long, n long, sketch binary"), "prefixes")
    at = prefix.where("g is not null").select("g", "label")
    sites = stash(at.groupBy("g").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p <> q").select("g", "p"), "sites")
    pairs = stash(at.join(sites, "g").where("label <> p").select("p", "label").distinct(), "pairs")
    members = pairs.unionAll(pairs.select("p", F.col("p").alias("label")).distinct())
    members = stash(members.join(classes.select("label", "n"), "label"), "members")
    sizes = members.groupBy("p").agg(F.count("*").alias("_c"), F.sum("n").alias("_n"))
    sizes = stash(sizes.select("p", ((F.col("_c") > region) | (F.col("_n") > max_shingles)).alias("large")), "regions")
    members = members.join(sizes, "p")
    sketches = prefix.where("sketch is not null").groupBy("label").agg(F.min("sketch").alias("sketch"))
    small = members.where("not large").select("p", "label", "n").join(sketches, "label").select("p", "label", "n", "sketch")
    small = small.groupBy("p").applyInArrow(_hopeful(num, den), "p long, label long, n long").withColumn("large", F.lit(False))
    left = stash(small.unionByName(members.where("large").select("p", "label", "n", "large")), "hopeful")

    again = stash(left.select("label").distinct().join(classes.select("label", "first"), "label"), "again")
    known = F.broadcast(again) if again.count() <= BROADCAST else again
    texts = narrow.join(known, narrow["doc_id"] == again["first"]).select("text", "label")
    sets = stash(texts.mapInArrow(_sets(words), "label long, shingles binary"), "sets")
    edges = left.where("not large").select("p", "label").join(sets, "label").groupBy("p").applyInArrow(_solved(num, den), "a long, b long")
    big = left.where("large").select(F.col("p").alias("region"), "label")
    if not big.isEmpty():
        edges = edges.unionAll(voronoi(big, sets, num, den, region, max_shingles))
    root = components(edges)

    part = stash(classes.join(root, classes["label"] == root["node"], "left").select("label", "first", F.coalesce("root", "label").alias("root")), "rooted")
    least = stash(part.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = stash(part.join(least, "root").select("label", "component_id"), "named")
    return rows.join(named, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows whose document is the least of its component; rows with a null key and rows without words stay.

    Rows that repeat with one key stay together. All columns pass through.
    """
    out = jaccard_components(docs, key, text, **options)
    gone = stash(out.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    few = F.broadcast(gone) if gone.count() <= BROADCAST else gone
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # safe from names that clash with ours
    name = dict(zip(docs.columns, plain.columns, strict=True))
    return plain.join(few, plain[name[key]].cast("long") == gone["_gone"], "left_anti").toDF(*docs.columns)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=4, threshold=(85, 100))


#: Small tables only: it counts common shingles of all pairs that share one.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM
  (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM e JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, least(d.doc_id, min(r.b)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN r ON d.doc_id = r.a GROUP BY d.doc_id"""
