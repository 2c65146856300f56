"""Removal of word sequences that a document with a smaller id has too, by prefix-partitioned suffix trees.

Suffixes that can't have company are left out first. A document's suffixes of `window` words and more go by a hash
to groups of bounded size; one whose 32-bit fingerprint nobody else in its group has is alone, whatever follows. A
first pass sends fingerprints and places only, 5 bytes or so a suffix. Fingerprints that agree by chance keep a few
suffixes too many and no more: what is removed is decided on words.

The others enter the trees with their words. Prefixes of variable length split them into groups that fit in memory: a
suffix goes by the shortest of its prefixes of 1, 2, 4, 8 and `window` words that few enough suffixes share, by
counts of all of them from the first pass. A group's suffixes are sorted word by word, and the longest common
prefixes of neighbours (LCP) make the tree: an interval with LCP of `window` or more is a deep internal node, a
repeat. Suffixes are cut after `window` words, as deeper nodes remove no further words; neighbouring windows
of a document join to maximal repeats. Of a node all suffixes go but those of the smallest document.

A task builds the nodes of its own suffixes first and sends each on once, with its words, its smallest document and
that document's places; the suffixes of other documents there are settled. So a passage in a third of all documents costs
a group one entry per task's buffer. Documents longer than PIECE words come in pieces that overlap by a window.

Rows are grouped to buffers in the order in which they come. Where the input comes from a shuffle it is sorted
within partitions, so that a task that runs again builds the same buffers.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.hashing import SLICE, in_batches, joined, mixed, table_rows, widened, word_hashes
from marlstone.llm.scratch import stash

WINDOW = 13
#: Prefix lengths before the whole window.
PREFIXES = (1, 2, 4, 8)
#: Fingerprints of a group, suffixes of a tree's group, words of a task's buffer and of a piece of a document.
PRINTS, GROUP, BUFFER, PIECE = 1_000_000, 500_000, 500_000, 1 << 20
#: Bits of the cells of a prefix length's counts: some four cells for each group, between these bounds.
CELL_BITS = (14, 22)
#: The most bytes of candidates or removed spans that are broadcast, as rows and their hash table take them; more are joined by a shuffle.
BROADCAST = 64 << 20

NO_ID = np.iinfo(np.int64).max  # a null id is larger than all others


def sequence_hashes(h: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each length the hashes of all sequences of so many words."""
    double, n = {1: h}, 1
    while 2 * n <= max(lengths):
        double[2 * n] = joined(double[n][: max(0, len(double[n]) - n)], double[n][n:], n)
        n *= 2
    out = {}
    for length in lengths:
        parts = [p for p in reversed(double) if length & p]
        total, done = None, 0
        for p in parts:
            at = double[p][done : done + max(0, len(h) - length + 1)]
            total = at if total is None else joined(total, at, done)
            done += p
        out[length] = mixed(total)
    return out


@dataclass
class Buffer:
    """Pieces of documents in a row: (id, hash of the text, first word, words, chosen windows or None for all)."""

    window: int
    pieces: list[tuple] = field(default_factory=list)
    n: int = 0

    def add(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.n += len(piece[3])

    def close(self) -> None:
        """Order the pieces by document, and number words and windows through all of them."""
        self.pieces.sort(key=lambda x: x[:3])
        self.ids = np.array([x[0] for x in self.pieces], np.int64)
        self.texts = np.array([x[1] for x in self.pieces], np.int64)
        self.bases = np.array([x[2] for x in self.pieces], np.int64)
        lengths = np.array([len(x[3]) for x in self.pieces])
        self.windows = lengths - self.window + 1
        self.word_start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        self.window_start = np.concatenate(([0], np.cumsum(self.windows)[:-1]))
        self.name = int(np.frombuffer(hashlib.blake2b(self.ids.tobytes() + self.texts.tobytes() + self.bases.tobytes(), digest_size=8).digest(), np.int64)[0])

    def word_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of windows: their pieces, and their first words."""
        of = np.searchsorted(self.window_start, places, "right") - 1
        return of, places - self.window_start[of] + self.word_start[of]

    def head(self, groups: int, marked: np.ndarray) -> tuple:
        """The row that says what the buffer holds and which windows it has marked itself."""
        return (self.name % groups, 1, self.name, np.stack([self.ids, self.texts, self.bases]).tobytes(), self.windows.astype("<u4").tobytes(), zlib.compress(np.packbits(marked).tobytes(), 1), b"")


def _cut(doc_id: int | None, text_hash: int, words: list[bytes], window: int, piece: int) -> Iterator[tuple]:
    for base in range(0, len(words) - window + 1, piece):
        yield NO_ID if doc_id is None else doc_id, text_hash, base, words[base : base + piece + window - 1]


def _filled(pieces: Iterator[tuple], window: int, most: int) -> Iterator[Buffer]:
    buffer = Buffer(window)
    for x in pieces:
        buffer.add(x)
        if buffer.n >= most:
            buffer.close()
            yield buffer
            buffer = Buffer(window)
    if buffer.pieces:
        buffer.close()
        yield buffer


def _in_order(keys: np.ndarray) -> np.ndarray:
    """Like a stable argsort, by two unstable ones, which are faster on long integers."""
    order = np.argsort(keys)
    run = np.cumsum(np.concatenate(([0], keys[order][1:] != keys[order][:-1]))) * len(keys)
    return np.sort(run + order) - run


def _by_group(group: np.ndarray, groups: int) -> np.ndarray:
    return np.argsort(group.astype(np.min_scalar_type(groups)), kind="stable")


def _packed(deltas: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest type that holds them, the type's size first."""
    kind = np.min_scalar_type(int(deltas.max())) if len(deltas) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + deltas.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.uint64)).astype(np.int64)


def _rising(x: np.ndarray) -> np.ndarray:
    return np.diff(x.astype(np.uint64), prepend=np.uint64(0))


#: kind 0: places in a buffer with what a group needs of them; 1: a buffer's head; 2: counts
_ROW = "kind int, buffer long, a binary, b binary, c binary, d binary"
_NAMES = ["kind", "buffer", "a", "b", "c", "d"]
_KINDS = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def _sent(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 256):
        columns = zip(*rows[a : a + 256], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), *_KINDS), strict=True)], names=["group", *_NAMES])


def _given(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_KINDS)
    return pa.table({n: pa.array(x, t) for n, x, t in zip(_NAMES, columns, _KINDS, strict=True)})


# ---- first pass: who has company ----


def _levels(window: int) -> tuple[int, ...]:
    return tuple(p for p in PREFIXES if p < window)


def _prints(window: int, most: int, piece: int, groups: int, bits: int):
    """Fingerprints of windows for their groups, buffers' heads, and at the end of a task its counts of prefixes."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in in_batches(batches):
            for i, h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for x in _cut(i, h, (t or b"").split(), window, piece):
                    yield *x[:3], word_hashes(x[3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, levels = None, _levels(window)
        for buffer in _filled(pieces(batches), window, most):
            every = np.arange(int(buffer.windows.sum()))
            first_word = every + np.repeat(buffer.word_start - buffer.window_start, buffer.windows)
            at = sequence_hashes(np.concatenate([x[3] for x in buffer.pieces]), (*levels, window))
            if levels:
                counts = np.stack([np.bincount((at[p][first_word] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) for p in levels])
                table = counts if table is None else table + counts
            whole = at[window][first_word]
            order = np.argsort(whole)
            sorted_ = whole[order]
            new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
            marked = np.zeros(len(every), bool)
            marked[order] = ~(new & np.concatenate((new[1:], [True])))  # several windows here have this hash
            send = np.sort(np.minimum.reduceat(order, np.flatnonzero(new)))
            group = ((whole[send] >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
            by = _by_group(group, groups)
            send, group = send[by], group[by]
            edges = np.flatnonzero(np.diff(group, prepend=-1, append=groups))
            rows = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                x = send[a:b]
                rows.append((int(group[a]), 0, buffer.name, whole[x].astype(np.uint32).tobytes(), _packed(_rising(x)), b"", b""))
            yield from _sent([*rows, buffer.head(groups, marked)])
        if table is not None:
            parts = table_rows(table)
            yield from _sent([(-1 - s, 2, s, c, b"", b"", b"") for s, c in zip(parts.column(0).to_pylist(), parts.column(1).to_pylist(), strict=True)])

    return run


def _company(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A group's windows that share a fingerprint with others, per buffer. Heads pass, counts are added up."""
    out, sent, total = [], [], None
    for r in table.select(_NAMES).to_pylist():
        if r["kind"] == 2:
            x = widened(r["a"])
            total = x if total is None else total + x
        elif r["kind"] == 1:
            out.append(tuple(r.values()))
        else:
            sent.append(r)
    if total is not None:
        out.append((2, -1 - key[0].as_py(), total.tobytes(), b"", b"", b""))
    if sent:
        prints = np.concatenate([np.frombuffer(r["a"], np.uint32) for r in sent])
        order = np.argsort(prints)
        same = prints[order][1:] == prints[order][:-1]
        shared = np.zeros(len(prints), bool)
        shared[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        ends = np.cumsum([len(r["a"]) // 4 for r in sent])
        for r, a, b in zip(sent, np.concatenate(([0], ends[:-1])), ends, strict=True):
            if (some := shared[a:b]).any():
                out.append((0, r["buffer"], _packed(_rising(_unpacked(r["b"])[some])), b"", b"", b""))
    return _given(out)


def _marked(table: pa.Table) -> tuple[np.ndarray, ...]:
    """From a buffer's head and replies: ids, texts, bases, windows of its pieces, and whether each window is marked, by itself or by others."""
    head, places = None, []
    for r in table.to_pylist():
        if r["kind"]:
            head = r
        else:
            places.append(_unpacked(r["a"]))
    ids, texts, bases = np.frombuffer(head["a"], np.int64).reshape(3, -1)
    windows = np.frombuffer(head["b"], "<u4").astype(np.int64)
    marked = np.unpackbits(np.frombuffer(zlib.decompress(head["c"]), np.uint8), count=int(windows.sum())).astype(bool)
    for x in places:
        marked[x] = True
    return ids, texts, bases, windows, marked


def _candidates(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A buffer's pieces with candidates: a bit for each window."""
    ids, texts, bases, windows, marked = _marked(table)
    ends = np.cumsum(windows)
    bits = [marked[b - n : b] for n, b in zip(windows, ends, strict=True)]
    on = np.array([x.any() for x in bits], bool)
    data = [np.packbits(x).tobytes() for x, k in zip(bits, on, strict=True) if k]
    return pa.table({"_id": pa.array(ids[on], pa.int64(), mask=ids[on] == NO_ID), "_text": pa.array(texts[on], pa.int64()), "base": pa.array(bases[on], pa.int64()), "bits": pa.array(data, pa.binary()), "n": pa.array([int(x.sum()) for x, k in zip(bits, on, strict=True) if k], pa.int64())})


# ---- second pass: trees of the candidates ----


def _numbers(texts: list[bytes], index: defaultdict) -> np.ndarray:
    return np.fromiter(map(index.__getitem__, texts), np.int32, len(texts))


def _index() -> defaultdict:
    return defaultdict(itertools.count().__next__)


def _written(suffixes: list[list[bytes]]) -> bytes:
    text = b"\n".join(map(b" ".join, suffixes))
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def _read(data: bytes) -> list[bytes]:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True).split(b"\n")


def nodes(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of numbered words in lexical order, and the longest common prefix of each with the one before (-1 for the first)."""
    n = suffixes.shape[1]
    two = [(suffixes[:, i].astype(np.int64) << 32) | (suffixes[:, i + 1] if i + 1 < n else 0) for i in range(0, n, 2)]  # a key for two words
    order = np.lexsort(two[::-1])
    s = suffixes[order]
    differ = s[1:] != s[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), s.shape[1])
    return order, np.concatenate(([-1], lcp))


def _suffixes(window: int, most: int, piece: int, few: list[np.ndarray], bits: int, groups: int):
    """A buffer's distinct candidates for their groups, with words, smallest document and places; and its head with what is settled."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in in_batches(batches):
            for i, h, t, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chosen = {x["base"]: x["bits"] for x in found}
                for x in _cut(i, h, (t or b"").split(), window, piece):
                    if x[2] in chosen:
                        yield *x, np.flatnonzero(np.unpackbits(np.frombuffer(chosen[x[2]], np.uint8), count=len(x[3]) - window + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buffer in _filled(pieces(batches), window, most):
            index, words = _index(), list(itertools.chain.from_iterable(x[3] for x in buffer.pieces))
            ids = _numbers(words, index)
            hashes = word_hashes(list(index))[ids]
            places = np.concatenate([x[4] + s for x, s in zip(buffer.pieces, buffer.window_start, strict=True)])
            of, at = buffer.word_of(places)
            hashed = sequence_hashes(hashes, (*_levels(window), window))
            whole = hashed[window][at]
            # equal hashes stand together, the smallest document first; words tell where a node ends. A node in two parts is two entries.
            order = _in_order(whole)
            rows = ids[at[order][:, None] + np.arange(window)]
            new = np.concatenate(([True], (whole[order][1:] != whole[order][:-1]) | (rows[1:] != rows[:-1]).any(axis=1)))
            node = np.cumsum(new) - 1
            doc = buffer.ids[of[order]]
            smallest = doc[new]
            settled = doc > smallest[node]
            marked = np.zeros(int(buffer.windows.sum()), bool)
            marked[places[order[settled]]] = True
            group = np.zeros(len(smallest), np.int64)
            todo, start = np.ones(len(smallest), bool), at[order[new]]
            for level, p in enumerate((*_levels(window), window)):
                h = hashed[p][start]
                cell = (h >> np.uint64(64 - bits)).astype(np.int64)
                mine = todo & few[level][cell] if p < window else todo
                key = mixed((cell[mine] + (level << bits)).astype(np.uint64)) if p < window else h[mine]
                group[mine] = (key % np.uint64(groups)).astype(np.int64)
                todo &= ~mine
            first = places[order[new]]
            more = np.flatnonzero(~new & ~settled)  # further places of the smallest document
            by = np.lexsort((first, group))
            rank = np.empty(len(by), np.int64)
            edges = np.flatnonzero(np.diff(group[by], prepend=-1, append=groups))
            out = []
            rank[by] = np.arange(len(by)) - np.repeat(edges[:-1], np.diff(edges))
            extra = np.stack([rank[node[more]], places[order[more]]], axis=1).astype("<u4")
            extra_group = group[node[more]]
            extra = extra[np.argsort(extra_group, kind="stable")]
            extra_ends = np.searchsorted(np.sort(extra_group), group[by][edges[:-1]], "right") if len(edges) > 1 else []
            extra_starts = np.searchsorted(np.sort(extra_group), group[by][edges[:-1]], "left") if len(edges) > 1 else []
            for a, b, c, d in zip(edges[:-1], edges[1:], extra_starts, extra_ends, strict=True):
                x = by[a:b]
                docs = _packed(_rising(smallest[x].view(np.uint64) + np.uint64(1 << 63)))
                out.append((int(group[x[0]]), 0, buffer.name, _written([words[i : i + window] for i in start[x].tolist()]), docs, _packed(_rising(first[x])), extra[c:d].tobytes()))
            yield from _sent([*out, buffer.head(groups, marked)])

    return run


def _trees(window: int):
    """A group's deep nodes: per buffer the places of suffixes to remove. Heads pass.

    Equal suffixes are one leaf with several entries; the tree is built over the leaves.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out, sent, leaves, leaf = [], [], _index(), []
        for r in table.select(_NAMES).to_pylist():
            if r["kind"]:
                out.append(tuple(r.values()))
            else:
                leaf.append(_numbers(_read(r["a"]), leaves))
                sent.append((r["buffer"], r["b"], r["c"], r["d"]))
        if sent:
            order, lcp = nodes(_numbers(b" ".join(leaves).split(), _index()).reshape(-1, window))
            node_of = np.empty(len(order), np.int64)
            node_of[order] = np.cumsum(lcp < window) - 1
            node = node_of[np.concatenate(leaf)]
            doc = np.concatenate([(_unpacked(x[1]).view(np.uint64) - np.uint64(1 << 63)).view(np.int64) for x in sent])
            smallest = np.full(len(order), NO_ID)
            np.minimum.at(smallest, node, doc)
            gone = doc > smallest[node]
            ends = np.cumsum([len(x) for x in leaf])
            for (buffer, _, first, more), a, b in zip(sent, np.concatenate(([0], ends[:-1])), ends, strict=True):
                if (some := gone[a:b]).any():
                    extra = np.frombuffer(more, "<u4").reshape(-1, 2).astype(np.int64)
                    places = np.sort(np.concatenate([_unpacked(first)[some], extra[some[extra[:, 0]], 1]]))
                    out.append((0, buffer, _packed(_rising(places)), b"", b"", b""))
        return _given(out)

    return run


def _spans(window: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """A buffer's pieces with removed words: starts and ends of maximal runs by turns."""
        ids, texts, bases, windows, gone = _marked(table)
        starts = np.concatenate(([0], np.cumsum(windows)[:-1]))
        at = np.flatnonzero(gone)
        of = np.repeat(np.arange(len(windows)), windows)[at]
        place = at - starts[of] + bases[of]
        new = np.ones(len(at), bool)
        new[1:] = (of[1:] != of[:-1]) | (place[1:] > place[:-1] + window)
        runs = np.flatnonzero(new)
        ends = np.concatenate((runs[1:], [len(at)])).astype(np.int64) - 1 if len(at) else runs
        span = np.stack([place[runs], place[ends] + window], axis=1).astype(np.int32)
        docs, begin = np.unique(of[runs], return_index=True)
        lists = [x.ravel().tolist() for x in np.split(span, begin[1:])] if len(docs) else []
        known = ids[docs]
        return pa.table({"_id": pa.array(known, pa.int64(), mask=known == NO_ID), "_text": pa.array(texts[docs], pa.int64()), "base": pa.array(bases[docs], pa.int64()), "removed": pa.array(lists, pa.list_(pa.int32()))})

    return run


# ---- the whole ----


def _steady(rows: DataFrame) -> DataFrame:
    """rows (i, h, ...) in an order that a task which runs again finds again: files give one, a shuffle needs a sort."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return rows.sortWithinPartitions("i", "h") if re.search(r"(?<!Broadcast)Exchange", plan) else rows


def _joined_to(rows: DataFrame, right: DataFrame, size: int, how: str) -> DataFrame:
    on = rows["i"].eqNullSafe(right["_id"]) & (rows["h"] == right["_text"])
    return rows.join(F.broadcast(right) if size <= BROADCAST else right, on, how).drop("_id", "_text")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, group: int = GROUP, buffer: int = BUFFER, piece: int = PIECE, prints: int = PRINTS) -> DataFrame:
    """Rows _id, _text (hash of the text), _removed: for each text with words to remove, starts and ends by turns, in order; some may overlap."""
    narrow = docs.select(docs[key].cast("long").alias("i"), F.xxhash64(docs[text]).alias("h"), docs[text].cast("binary").alias("t"))
    narrow = _steady(narrow)
    letters = narrow.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    groups = max(1, letters // (6 * prints))  # about as many words; an estimate will do here
    bits = min(max(CELL_BITS[0], (4 * letters // (6 * group)).bit_length()), CELL_BITS[1])
    found = narrow.mapInArrow(_prints(window, buffer, piece, groups, bits), f"group long, {_ROW}").groupBy("group").applyInArrow(_company, _ROW)
    found = stash(found, "company")
    levels = _levels(window)
    counts = np.zeros(len(levels) << bits, np.int64)
    for r in found.where("kind = 2").select("buffer", "a").toLocalIterator():  # a table of bounded size
        counts[r["buffer"] * SLICE : (r["buffer"] + 1) * SLICE] = np.frombuffer(r["a"], np.int64)
    few = list(counts.reshape(len(levels), -1) <= group)
    hits = stash(found.where("kind < 2").groupBy("buffer").applyInArrow(_candidates, "_id long, _text long, base long, bits binary, n long"), "candidates")
    total = hits.agg(F.sum("n").alias("n"), F.sum(F.octet_length("bits") + 160).alias("s")).first()
    by_doc = hits.dropDuplicates(["_id", "_text", "base"]).groupBy("_id", "_text").agg(F.collect_list(F.struct("base", "bits")).alias("found"))
    chosen = _steady(_joined_to(narrow, by_doc, total["s"] or 0, "inner"))
    groups = max(1, -(-(total["n"] or 0) // group))
    rows = chosen.mapInArrow(_suffixes(window, buffer, piece, few, bits, groups), f"group long, {_ROW}")
    found = rows.groupBy("group").applyInArrow(_trees(window), _ROW)
    spans = found.groupBy("buffer").applyInArrow(_spans(window), "_id long, _text long, base long, removed array<int>")
    # rows that repeat can come from several buffers; what goes depends on the id and the words alone, so they are equal
    once = spans.dropDuplicates(["_id", "_text", "base"]).groupBy("_id", "_text").agg(F.array_sort(F.collect_list(F.struct("base", "removed"))).alias("x"))
    return once.select("_id", "_text", F.flatten("x.removed").alias("_removed"))


_KEPT = "struct<n_words:long,n_removed:long,kept:binary>"


def _keep(digest: bool):
    @F.arrow_udf(_KEPT)
    def keep(text: pa.Array, removed: pa.Array) -> pa.Array:
        rows = []
        for part in range(0, len(text), 256):
            for t, spans in zip(text.slice(part, 256).to_pylist(), removed.slice(part, 256).to_pylist(), strict=True):
                words = (t or b"").split()
                n, gone = len(words), 0
                if spans:
                    left, at = [], 0
                    for a, b in zip(spans[::2], spans[1::2], strict=True):
                        left += words[at:a]
                        gone += b - max(a, at)
                        at = b
                    words = left + words[at:]
                whole = b" ".join(words)
                rows.append({"n_words": n, "n_removed": gone, "kept": hashlib.sha256(whole).hexdigest().encode() if digest else whole})
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())]))

    return keep


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, digest: bool = False, **options) -> DataFrame:
    """The input rows and columns with _n_words, _n_removed and _kept (the kept words joined by spaces, or with digest their SHA-256).

    Null and empty texts have no words. Rows with one id don't remove words from each other, also if they repeat;
    a null id is larger than any other. Texts under `window` words keep all. No rows give no rows.
    """
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # safe from names that clash with ours
    name = dict(zip(docs.columns, plain.columns, strict=True))
    spans = stash(repeated_spans(plain, name[key], name[text], window, **options), "repeats")
    size = spans.agg(F.sum(F.size("_removed") * 4 + 128)).first()[0] or 0
    x = plain.select(*plain.columns, plain[name[key]].cast("long").alias("i"), F.xxhash64(plain[name[text]]).alias("h"))
    x = _joined_to(x, spans, size, "left").select(*plain.columns, _keep(digest)(F.col(name[text]).cast("binary"), F.col("_removed")).alias("_x"))
    return x.select(*plain.columns, "_x.n_words", "_x.n_removed", F.col("_x.kept").cast("string").alias("k")).toDF(*docs.columns, "_n_words", "_n_removed", "_kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs, digest=True).select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept").alias("kept_sha256"))


#: Small tables only: a window is a list of 13 words here.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS u(i)),
m AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS least FROM g) WHERE doc_id > least),
r AS (SELECT DISTINCT doc_id, i + j AS p FROM m, unnest(range(0, 13)) AS u(j)),
k AS (SELECT d.doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
s AS (SELECT k.doc_id, array_to_string(list(word ORDER BY k.p), ' ') AS kept, count(*) AS n FROM k ANTI JOIN r ON k.doc_id = r.doc_id AND k.p = r.p GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s ON d.doc_id = s.doc_id"""
