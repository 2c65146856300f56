"""Word hashes in Python workers, and counting tables that tasks fill and the cluster adds up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marlstone.llm.worker import kept

#: An odd 64-bit multiplier for sequences, and the words whose hashes a worker keeps.
MULTIPLIER, CACHE = 0x9E3779B97F4A7C15, 250_000


class _Cache(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    cache = kept("word hashes", _Cache)
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def power(n: int) -> np.uint64:
    return np.uint64(pow(MULTIPLIER, n, 1 << 64))


def joined(left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Hashes of sequences from those of their first `length` words and of the rest."""
    return left + right * power(length)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits spread, so that any of them can be used by themselves."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


SLICE = 1 << 14


def narrow(counts: np.ndarray) -> bytes:
    """Counts below 2^32 in the narrowest type that holds them, the type's size first."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def table_rows(tables: np.ndarray) -> pa.RecordBatch:
    """A task's counts as rows (slice, counts) of fixed size; slices of zeros are left out."""
    parts = tables.reshape(-1, SLICE)
    some = np.flatnonzero(parts.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([narrow(parts[i]) for i in some], pa.binary())], names=["slice", "counts"])


def summed(rows: DataFrame, entries: int) -> np.ndarray:
    """The sums of all tasks' tables. They are added up on the executors; a table of bounded size reaches the driver."""

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for x in table.column("counts").to_pylist():
            total += widened(x)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(entries, np.int64)
    for r in rows.groupBy("slice").applyInArrow(add, "slice int, counts binary").toLocalIterator():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.int64)
    return out


def in_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


