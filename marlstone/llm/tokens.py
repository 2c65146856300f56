"""Token counts of texts of any length by overlap resynchronisation.

A text longer than a chunk is encoded chunk by chunk, each reaching back over the end of the one before. Byte
offsets of the tokens show where both encodings hold the same token at the same place; there they are spliced.

Why that is exact: a byte-pair encoder that always joins the adjacent pair of best rank (leftmost first) gives a
sequence of tokens if and only if it gives every two neighbours of it for their own text. Left of a shared token
all neighbours come from one encoding and right of it from the other, and the shared token has its own neighbours
on both sides, so the spliced sequence is the encoding of the whole. Where no token is shared, as in long runs of
one character, the overlap doubles until one is, at worst back to the start of the chunk before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.worker import kept

#: Bytes of a chunk and of the first overlap.
CHUNK, OVERLAP = 1 << 16, 256
#: A character in no piece: nothing merges with it, so what follows is encoded without the leading blank.
WALL = "\n"


class Pieces:
    """A sentencepiece model with the bytes that each id stands for. ValueError for one that does more than put a blank first."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes_of = np.array([1 if self.model.is_byte(i) else len(s.replace("▁", " ").encode()) for i, s in enumerate(names)], np.int64)
        whole = {bytes([b]) for b in range(256)} <= {bytes([int(s[3:5], 16)]) for i, s in enumerate(names) if self.model.is_byte(i)}
        if any(WALL in s for s in names) or not whole or self.model.normalize("a  b" + WALL + "ﬁ ") != "▁a▁▁b" + WALL + "ﬁ▁":
            raise ValueError(f"{path} changes texts before it cuts them or lacks pieces for bytes; chunks of a text can't be spliced under it")

    def first(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)

    def later(self, text: str) -> np.ndarray:
        """Ids of text as it stands in the middle of another."""
        head = self.model.encode(WALL)
        ids = self.model.encode(WALL + text)
        assert ids[: len(head)] == head
        return np.array(ids[len(head) :], np.int64)


def _starts(at: int, lengths: np.ndarray) -> np.ndarray:
    return at + np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.empty(0, np.int64)


def resynchronised(pieces: Pieces, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[np.ndarray]:
    """The ids of text, some at a time. Offsets count from -1, where the leading blank stands."""
    raw = text.replace("▁", " ").encode()  # the model writes blanks so, hence both give the same pieces
    if len(raw) <= chunk:
        yield pieces.first(text)
        return

    def whole(i: int) -> int:
        """The start of the character that byte i is in."""
        while 0 < i < len(raw) and raw[i] & 0xC0 == 0x80:
            i -= 1
        return i

    def encode(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and starts for the bytes from a to b."""
        part = raw[a:b].decode()
        ids = pieces.first(part) if a == 0 else pieces.later(part)
        lengths = pieces.bytes_of[ids]
        assert lengths.sum() == b - a + (a == 0)
        return ids, _starts(a - (a == 0), lengths)

    done: list[tuple[np.ndarray, np.ndarray]] = []  # spliced so far; given out at the end, as an overlap may reach back into it
    end = whole(chunk)
    ids, starts = encode(0, end)
    while end < len(raw):
        back, to = overlap, len(raw) if end + chunk >= len(raw) else whole(end + chunk)
        while True:
            at = max(0, whole(end - back))
            while done and at <= starts[0]:
                before = done.pop()
                ids, starts = np.concatenate((before[0], ids)), np.concatenate((before[1], starts))
            new_ids, new_starts = encode(at, to)
            if at == 0:
                ids, starts = new_ids, new_starts
                break
            low = np.searchsorted(starts, at)
            _, i, j = np.intersect1d(starts[low:], new_starts, assume_unique=True, return_indices=True)
            same = np.flatnonzero(ids[low + i] == new_ids[j])
            if len(same):
                k = same[len(same) // 2]
                done.append((ids[: low + i[k]], starts[: low + i[k]]))
                ids, starts = new_ids[j[k] :], new_starts[j[k] :]
                break
            back *= 2
        end = to
    yield from (x for x, _ in done)
    yield ids


def count_tokens(path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """An Arrow function: the number of tokens of each text under the sentencepiece model in the file path."""

    @F.arrow_udf("long")
    def count(text: pa.Array) -> pa.Array:
        pieces = kept(("pieces", path), lambda: Pieces(path))
        texts = [x or "" for x in text.to_pylist()]
        out = [0] * len(texts)
        short = [i for i, x in enumerate(texts) if len(x) * 4 <= chunk]
        for i, ids in zip(short, pieces.model.encode([texts[i] for i in short], num_threads=1), strict=True):
            out[i] = len(ids)
        for i, x in enumerate(texts):
            if len(x) * 4 > chunk:
                out[i] = sum(len(ids) for ids in resynchronised(pieces, x, chunk, overlap))
        return pa.array(out, pa.int64())

    return count


def token_counts(docs: DataFrame, path: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The input rows and columns with _n_bytes and _n_tokens.

    Null is as empty: 0 and 0. Rows are independent: repeated rows, nulls in other columns and any other columns
    pass through; no rows give no rows. Nothing is shuffled.
    """
    column: Column = F.coalesce(docs[text], F.lit(""))
    return docs.withColumns({"_n_bytes": F.octet_length(column).cast("long"), "_n_tokens": count_tokens(path, chunk, overlap)(column)})


def op1_token_counts(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_tokens").alias("n_tokens"), (F.col("_n_tokens") > limit).alias("over_limit"))
