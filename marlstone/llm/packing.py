"""Packing of documents into sequences of fixed length by a grouping genetic algorithm.

Pieces are dealt at random to shards of bounded size, and a shard is first packed by best fit, longest first. A
packing as short as the sum of lengths allows can't be bettered and ends a shard's search. Every other shard is
worked on by ISLANDS islands, groups of their own in the shuffle, each with a population of packings that it keeps from
epoch to epoch. An island breeds: a child takes over well-filled bins of one parent whole, drops the other parent's
bins that share a piece with them, and puts what lost its bin back by best fit, longest first. After each epoch its
elite, the best packing, joins the population of the next island of the ring. The best packing of a shard stands, but for
its worst-filled bins: their pieces go on to a next level with fewer shards, down to one, so the rounding loss of a
shard isn't paid by the whole.
"""

from __future__ import annotations

import bisect
import random
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.scratch import stash
from marlstone.llm.worker import kept

LIMIT, END = 4096, 1
#: Pieces of a shard (at most about twice that), islands of a shard, epochs, children per epoch, packings kept.
SHARD, ISLANDS, EPOCHS, CHILDREN, POPULATION = 8192, 4, 3, 12, 6
#: Of a shard's bins, one in so many goes on to the next level, the worst filled.
RESIDUE = 24

Bins = list[list[int]]


# ---- pieces ----


#: Latin letters that fold to one letter each and that no normalisation changes, and a mark that may follow.
LATIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿŒœ]+)([.,;:!?]?)")


def _byte_letters() -> dict[int, str]:
    """The usual letters for bytes in byte-level vocabularies: visible Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}


class _Known(dict):
    """Ids by words; a word that isn't there is learnt."""

    def __init__(self, words: Words):
        super().__init__()
        self.words = words

    def __missing__(self, w: bytes) -> bytes:
        return self.words.learn(w)


class Words:
    """Ids of words between ASCII spaces under a tokenizer that never joins anything across white space, as bytes.

    Known words stand in two generations: when the young one is full it becomes the old one, and words that are met
    again come back, so frequent words stay. Words of Latin letters, with a mark after them or not, go to the
    tokenizer's merges directly, if some samples show that it folds and parts them as this does; others go the whole way.
    """

    MOST, LONGEST = 350_000, 64

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.young: dict[bytes, bytes] = _Known(self)
        self.old: dict[bytes, bytes] = {}
        self.marks = {c: self._whole([c])[0] for c in ".,;:!?"}
        self.byte_marks = {ord(c): ids for c, ids in self.marks.items()}
        letters = [c for c in map(chr, range(0x41, 0x180)) if LATIN.fullmatch(c)]
        samples = ["Abc", "straße", "Œuvre", "ÉTÉ", "niño", "thththat", "x", "ÿ", "a" * 70, *(f"{c}a{c}on" for c in letters)]
        self.direct = all(self._whole([f"{w}{c}"])[0] == self._latin(w.lower()) + self.marks.get(c, b"") for w in samples for c in ["", *self.marks])

    def _whole(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _latin(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def learn(self, w: bytes) -> bytes:
        """The ids of a word that isn't among the young ones."""
        young, old = self.young, self.old
        if (ids := old.get(w)) is None:
            mark = self.byte_marks.get(w[-1], b"") if self.direct else b""
            bare = w[:-1] if mark else w
            if self.direct and bare.isalpha():  # ASCII letters only
                key = bare.lower()
            elif self.direct and (m := LATIN.fullmatch(w.decode("utf-8", "replace"))):
                key = m[1].lower().encode()
            else:
                key = b""
            if not key:
                ids = self._whole([w.decode("utf-8", "replace")])[0]
            else:
                if not (ids := young.get(key) or old.get(key)):
                    ids = self._latin(key.decode())
                    if len(key) <= self.LONGEST:
                        young[key] = ids
                ids += mark
        if len(w) <= self.LONGEST:
            young[w] = ids
        return ids

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        if len(self.young) > self.MOST:
            self.old, self.young = self.young, _Known(self)
        known = self.young.__getitem__
        return [b"".join(map(known, (x or b"").split())) for x in texts]


def cut(ids: bytes, limit: int) -> Iterator[tuple[int, int, bytes]]:
    """(piece, start, ids of it)"""
    for k, a in enumerate(range(0, len(ids), 4 * limit)):
        yield k, a // 4, ids[a : a + 4 * limit]


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, end: int = END, with_ids: bool = False) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32 and, if asked for, ids (32-bit, little-endian) of every document.

    A document is its text's ids and then the id `end`; null text is as empty and gives that id alone. Only longer
    documents than `limit` are cut. Null keys stay null; each of several equal rows gives its own pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(("words", tokenizer), lambda: Words(tokenizer))
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows = []
            column = batch.column(1)
            for a in range(0, len(column), 256):
                some = column.slice(a, 256).to_pylist()
                for i, ids in enumerate(words.ids(some)):
                    rows += [(a + i, k, start, len(x) // 4, zlib.crc32(x), x if with_ids else None) for k, start, x in cut(ids + last, limit)]
            if rows:
                of, *rest = zip(*rows, strict=True)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                out = [batch.column(0).take(pa.array(of)), *(pa.array(x, t) for x, t in zip(rest, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(out[: 5 + with_ids], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("binary").alias("text")).mapInArrow(run, schema)


# ---- the genetic algorithm on one shard ----


def _fit(bins: Bins, free: list[int], items: list[int], size: list[int], limit: int) -> None:
    """Put items into the bins, each into the fullest that holds it, or into a new one."""
    room = sorted(zip(free, range(len(bins)), strict=True))
    for i in items:
        at = bisect.bisect_left(room, (size[i], -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(i)
        else:
            left, b = limit, len(bins)
            bins.append([i])
            free.append(limit)
        free[b] = left - size[i]
        if free[b]:
            bisect.insort(room, (free[b], b))


def _value(bins: Bins, size: list[int], limit: int) -> tuple[int, float]:
    """Fewer bins are better, then more uneven filling, which leaves room where it can be used."""
    return len(bins), -sum((sum(size[i] for i in b) / limit) ** 2 for b in bins)


def best_fit(size: list[int], limit: int) -> Bins:
    """size is sorted from long to short."""
    bins: Bins = []
    _fit(bins, [], list(range(len(size))), size, limit)
    return bins


def _cross(a: Bins, b: Bins, size: list[int], limit: int, rng: random.Random) -> Bins:
    filled = sorted(b, key=lambda x: -sum(size[i] for i in x))
    best = filled[: max(1, len(filled) // 2)]
    taken = rng.sample(best, max(1, len(best) // 2))
    inside = {i for x in taken for i in x}
    rest, homeless = [], []
    for x in a:
        if inside.isdisjoint(x):
            rest.append(list(x))
        else:
            homeless += [i for i in x if i not in inside]
    for x in sorted(rest, key=lambda x: sum(size[i] for i in x))[: rng.randint(0, 3)]:  # mutation: some poor bins go
        rest.remove(x)
        homeless += x
    child = [list(x) for x in taken] + rest
    homeless.sort(key=lambda i: -size[i])
    _fit(child, [limit - sum(size[i] for i in x) for x in child], homeless, size, limit)
    return child


def evolve(size: list[int], limit: int, start: list[Bins], seed: int, children: int = CHILDREN, population: int = POPULATION) -> list[Bins]:
    """Packings of the items, the best first; size is sorted from long to short. start: the population to begin with."""
    rng = random.Random(seed)
    least = -(-sum(size) // limit)
    pool = [(_value(x, size, limit), x) for x in start or [best_fit(size, limit)]]
    pool.sort(key=lambda x: x[0])
    while len(pool) < population and pool[0][0][0] > least:  # best fit in an order that is only roughly from long to short
        blur = limit // 2 ** rng.randint(2, 6)
        bins: Bins = []
        _fit(bins, [], sorted(range(len(size)), key=lambda i: -size[i] + rng.randrange(blur + 1)), size, limit)
        bisect.insort(pool, (_value(bins, size, limit), bins), key=lambda x: x[0])
    for _ in range(children):
        if pool[0][0][0] <= least or len(pool) < 2:
            break
        a, b = rng.sample(pool, 2)
        child = _cross(a[1], b[1], size, limit, rng)
        if (value := _value(child, size, limit)) not in [v for v, _ in pool]:  # else most likely there already
            bisect.insort(pool, (value, child), key=lambda x: x[0])
        del pool[population:]
    return [x for _, x in pool[:population]]


# ---- islands ----

#: bins: the bin of the piece in each packing of the population, the best first
_ITEM = "uid long, length long, shard long, island int, source int, bins array<int>"


def _sorted(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["length", "uid"], ascending=[False, True], kind="stable")


def _columns(packings: list[Bins], n: int) -> list[list[int]]:
    out = np.empty((n, len(packings)), np.int32)
    for k, bins in enumerate(packings):
        for b, x in enumerate(bins):
            out[x, k] = b
    return out.tolist()


def _packings(column: pd.Series) -> list[Bins]:
    table = np.stack([np.asarray(x, np.int32) for x in column])
    out = []
    for bins in table.T:
        order = np.argsort(bins, kind="stable")
        out.append([x.tolist() for x in np.split(order, np.flatnonzero(np.diff(bins[order])) + 1)])
    return out


def _begin(limit: int):
    """Shards packed by best fit; done if no packing is shorter."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = _sorted(rows)
        size = rows["length"].astype(int).tolist()
        bins = best_fit(size, limit)
        return pd.DataFrame({"uid": rows["uid"], "length": rows["length"], "shard": rows["shard"], "bins": _columns([bins], len(size)), "done": len(bins) <= -(-sum(size) // limit)})

    return run


def _epoch(limit: int, islands: int, epoch: int, last: bool, seed: int, children: int, population: int):
    """An island's population and its guest from the island before, further bred; and its elite for the next one. At last its best alone."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(rows["shard"].iloc[0]), int(rows["island"].iloc[0])
        rows = _sorted(rows)
        own, guests = rows[rows["source"] == island], rows[rows["source"] != island]
        start = _packings(own["bins"]) + (_packings(guests["bins"]) if len(guests) else [])
        pool = evolve(own["length"].astype(int).tolist(), limit, start, hash((seed, shard, island, epoch)), children, population)
        out = pd.DataFrame({"uid": own["uid"].to_numpy(), "length": own["length"].to_numpy(), "shard": shard, "island": island, "source": island, "bins": _columns(pool[:1] if last else pool, len(own))})
        if islands == 1 or last:
            return out
        return pd.concat([out, out.assign(island=(island + 1) % islands, bins=_columns(pool[:1], len(own)))])

    return run


def _choose(limit: int, level: int, last: bool, residue: int):
    """Of a shard's packings the best, with each piece's place; -1 for what goes on to the next level."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        rows = rows.assign(bin=rows["bins"].map(lambda x: x[0]))
        own = min((g for _, g in rows.groupby("island", sort=True)), key=lambda g: (g["bin"].nunique(), -float(((g.groupby("bin")["length"].sum() / limit) ** 2).sum())))
        own = own.sort_values(["bin", "length", "uid"], ascending=[True, False, True], kind="stable")
        fill = own.groupby("bin")["length"].sum()
        gone = set() if last else set(fill[fill < limit].sort_values(kind="stable").index[: max(1, len(fill) // residue)])
        offset = own.groupby("bin")["length"].cumsum() - own["length"]
        on = own["bin"].isin(gone)
        return pd.DataFrame({"uid": own["uid"], "length": own["length"], "sequence_id": ((level << 56) + (shard << 20) + own["bin"].astype("int64")).where(~on, -1), "offset": offset.where(~on, -1)})

    return run


def pack(items: DataFrame, limit: int = LIMIT, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS, children: int = CHILDREN, population: int = POPULATION, seed: int = 0) -> DataFrame:
    """From rows (uid, length) with length from 1 to limit: uid, length, sequence_id and offset. uid must be unique.

    Loops over levels; each level's remaining rows are materialised, so a lost executor costs one level at most.
    Pieces of one length are told apart by uid, and of equally good packings the first is taken, so a rerun gives the same.
    """
    full = items.where(F.col("length") >= limit).select("uid", "length", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out, rest, level = full, items.where(F.col("length") < limit).select("uid", "length"), 0
    while n := rest.count():
        shards = -(-n // shard)
        rows = rest.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(seed + level)), F.lit(shards)).alias("shard"))
        begun = stash(rows.groupBy("shard").applyInPandas(_begin(limit), "uid long, length long, shard long, bins array<int>, done boolean"), f"begun{level}")
        rows = begun.where("not done").select("uid", "length", "shard", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), "bins")
        rows = rows.select("uid", "length", "shard", "island", F.col("island").alias("source"), "bins")
        for epoch in range(epochs):
            rows = rows.groupBy("shard", "island").applyInPandas(_epoch(limit, islands, epoch, epoch == epochs - 1, seed, children, population), _ITEM)
        rows = rows.unionByName(begun.where("done").select("uid", "length", "shard", F.lit(0).alias("island"), F.lit(0).alias("source"), "bins"))
        done = rows.groupBy("shard").applyInPandas(_choose(limit, level, shards == 1, RESIDUE), "uid long, length long, sequence_id long, offset long")
        done = stash(done, f"packed{level}")
        out = out.unionByName(done.where(F.col("sequence_id") >= 0))
        rest, level = done.where(F.col("sequence_id") < 0).select("uid", "length"), level + 1
    return out


def packed_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, **options) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every document and its place.

    See pieces() for nulls, empty and long texts and repeated rows. No rows give no rows.
    """
    cuts = stash(pieces(docs, tokenizer, key, text, limit).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    places = pack(cuts.select("uid", "length"), limit, **options).drop("length")
    return cuts.join(places, "uid").drop("uid")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
