"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Every pre-token keeps its byte segments in a linked list. A segment that can merge with its right
neighbour sits in the bucket of the merge's rank; a two-level bitmap marks the buckets in use, so
find-first-set gives the lowest rank in two steps. A bucket is a heap of positions (the leftmost
goes first), and entries whose segment has changed since are skipped when they surface. Work is
O(n log n) in the bytes of a pre-token, which matters for pre-tokens of many kilobytes.

Cases: a null or empty text has no tokens and decodes to no bytes; a null id list decodes to no
bytes; repeated rows give repeated results; an empty table gives an empty table; columns other than
the two named are not read.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import table, tokenizer_file
from freshet.llm.text import Memo

#: Pre-tokens remembered by a worker, in each of two generations, and bytes of an output batch.
PIECES = 300_000
BATCH_BYTES = 16 << 20
#: Bits of a word of the bitmap's lower level.
_SHIFT = 8


class BytePairCoder:
    """Ranks of one vocabulary file, its pre-token pattern, and the merges."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.pieces = Memo(self._piece, PIECES)

    def _piece(self, piece: str) -> bytes:
        return array("I", self.merge(piece.encode())).tobytes()

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the lowest-ranked pair merges first, the leftmost among equals."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        rank_at: list[int | None] = [ranks.get(piece[i : i + 2]) for i in range(n - 1)] + [None]
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        top = 0

        def put(rank: int, at: int) -> None:
            nonlocal top
            if rank in buckets:
                heappush(buckets[rank], at)
                return
            buckets[rank] = [at]
            words[rank >> _SHIFT] = words.get(rank >> _SHIFT, 0) | 1 << (rank & 255)
            top |= 1 << (rank >> _SHIFT)

        for i, rank in enumerate(rank_at):
            if rank is None:
                continue
            if rank in buckets:
                buckets[rank].append(i)  # ascending, and so a heap
            else:
                buckets[rank] = [i]
                high = rank >> _SHIFT
                words[high] = words.get(high, 0) | 1 << (rank & 255)
                top |= 1 << high
        while top:
            high = (top & -top).bit_length() - 1
            word = words[high]
            rank = high << _SHIFT | (word & -word).bit_length() - 1
            at = heappop(buckets[rank])
            if not buckets[rank]:
                del buckets[rank]
                words[high] = word & (word - 1)
                if not words[high]:
                    top &= top - 1
            if rank_at[at] != rank:
                continue
            gone = after[at]
            end = after[at] = after[gone]
            rank_at[gone] = rank_at[at] = None
            if end < n:
                before[end] = at
                now = rank_at[at] = ranks.get(piece[at : after[end]])
                if now is not None:
                    put(now, at)
            left = before[at]
            if left >= 0:
                now = rank_at[left] = ranks.get(piece[left:end])
                if now is not None:
                    put(now, left)
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : after[at]]])
            at = after[at]
        return out


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> BytePairCoder:
    return BytePairCoder(path, pattern)


def _mapped(batches: Iterator[pa.RecordBatch], make, names: list[str]) -> Iterator[pa.RecordBatch]:
    """make(value) gives the columns after the key; batches stay near BATCH_BYTES."""
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            made = make(value.as_py())
            rows.append((key, *made))
            held += sum(len(x) for x in made if isinstance(x, bytes)) + 64
            if held > BATCH_BYTES:
                yield _batch(rows, names)
                rows, held = [], 0
    if rows:
        yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"ids": pa.binary(), "bytes": pa.binary(), "n_tokens": pa.int64()}
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns)], names=names
    )


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ids (binary, little-endian unsigned 32-bit), n_tokens."""
    import public_tokenizers

    path = path or tokenizer_file("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches):
        own = coder(path, pattern)

        def make(value):
            ids = own.encode(value or "")
            return ids, len(ids) // 4

        return _mapped(batches, make, ["key", "ids", "n_tokens"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, ids binary, n_tokens long").withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per id list: key and the bytes that the ids stand for."""
    import public_tokenizers

    path = path or tokenizer_file("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches):
        own = coder(path, pattern)
        return _mapped(batches, lambda value: (own.decode(value or b""),), ["key", "bytes"])

    rows = encoded.select(F.col(key).cast("long").alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, "key long, bytes binary").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """encode and decode in one pass over the documents: key, ids, n_tokens, bytes (decoded from the ids)."""
    import public_tokenizers

    path = path or tokenizer_file("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches):
        own = coder(path, pattern)

        def make(value):
            ids = own.encode(value or "")
            return ids, len(ids) // 4, own.decode(ids)

        return _mapped(batches, make, ["key", "ids", "n_tokens", "bytes"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, ids binary, n_tokens long, bytes binary").withColumnRenamed("key", key)


def op1_bpe_roundtrip(spark, sf_dir) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    coded = round_trip(table(spark, sf_dir, "documents", "doc_id", "text"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )
