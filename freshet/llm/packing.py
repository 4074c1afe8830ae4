"""Sum-of-squares online packing of tokenized documents into fixed windows.

Each task packs the documents of its input split as they come. A document of more than a window's
tokens fills whole windows first; its remainder goes to the fill level that minimises the sum of
squared counts of partially filled windows, where level_counts[h] says how many windows hold h
tokens: moving one window from level h to h + s changes that sum by 2 * (count[h + s] - count[h]) + 2,
filling a window by 1 - 2 * count[h], opening one by 2 * count[s] + 1. Ties go to the fuller level.
Memory is bounded: beyond max_open partial windows, and at the end of a split, the emptiest windows
are cut to fill the fullest, so at most one window of a split stays partial; that one is cut into
lengths that are powers of two and so needs no padding.

Sequence ids are the task's number times 2**32 plus a count, so a task that runs again after a lost
executor writes the same rows.

Cases: a null or empty text is the single end id; repeated rows are packed each on its own; an empty
table gives no pieces; extra columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import table, tokenizer_file
from freshet.llm.text import KEY_LENGTH

#: Bytes of an output batch; characters of texts that are encoded together.
BATCH_BYTES, BATCH_CHARS = 8 << 20, 1 << 18
#: Pre-tokens of each of the memory's two generations; where no other stage shares the workers.
KNOWN, KNOWN_ALONE = 120_000, 300_000
#: Pre-tokens encoded as words of one line; the library takes a third longer for each in lines of thousands.
LINE = 30
#: The pre-token pattern of PLAIN over lower-cased Latin-1: contractions, letters, one number, others.
_LETTER, _NUMBER, _SPACE = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
#: What a tokenizer file must say for its pre-tokens to be cut by PIECE; with any other, texts go to the library whole.
PLAIN = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split", "behavior": "Removed", "invert": True,
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
WORD_END = "</w>"

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class PieceTokenizer:
    """Ids of texts as the library gives them, special tokens' strings included. Where the file's
    normal form and pattern are PLAIN, a text of Latin-1 characters is its own normal form but for
    lower case and white space, so its pre-tokens are cut here and their ids remembered. Unknown
    pre-tokens of many texts are encoded in one call, as words of short lines: the token that ends a
    word says so. All other texts, those that hold an added token, and all texts where the file says
    otherwise go to the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        added = [re.escape(x["content"]) for x in said.get("added_tokens") or []]
        self.added = re.compile("|".join(added)) if added else None
        model = said["model"]
        self.plain = {k: said.get(k) for k in PLAIN} == PLAIN and model["type"] == "BPE" and model.get("end_of_word_suffix") == WORD_END
        self.plain = self.plain and not any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in said.get("added_tokens") or [])
        if self.plain:
            self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.ends[[i for word, i in model["vocab"].items() if word.endswith(WORD_END)]] = True
            # pre-tokens need neither be made normal nor be cut again
            line = {"type": "Split", "behavior": "Removed", "invert": False, "pattern": {"String": " "}}
            bare = {"type": "Sequence", "pretokenizers": [line, PLAIN["pre_tokenizer"]["pretokenizers"][1]]}
            self.words = Tokenizer.from_str(json.dumps(said | {"normalizer": None, "pre_tokenizer": bare, "added_tokens": []}))
        self.most = KNOWN
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @cached_property
    def model(self):
        """The library's tokenizer, loaded for the first text that goes there whole."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _whole(self, text: str) -> bytes:
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        lines = [" ".join(pieces[at : at + LINE]) for at in range(0, len(pieces), LINE)]
        encoded = array("I")
        for line in self.words.encode_batch_fast(lines, add_special_tokens=False):
            encoded.extend(line.ids)
        ids = np.frombuffer(encoded, np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        data = ids.tobytes()
        if len(stops) != len(pieces):
            raise ValueError("a pre-token was not encoded as one word")
        cuts = [0, *(4 * stops).tolist()]
        return {piece: data[a:b] for piece, a, b in zip(pieces, cuts, cuts[1:])}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        cut: list[tuple[int, list, dict[int, str]]] = []
        fresh: set[str] = set()
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        for i, text in enumerate(texts):
            if not self.plain or not _latin(text) or (self.added and self.added.search(text)):
                out[i] = self._whole(text)
                continue
            pieces = PIECE.findall(text.lower())
            found = list(map(self.known.get, pieces))
            if None not in found:
                out[i] = b"".join(found)
                continue
            missing, at = {}, -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                missing[at] = pieces[at]
            cut.append((i, found, missing))
            fresh.update(missing.values())
        self.known |= {x: self.older[x] for x in fresh.intersection(self.older)}
        fresh = [x for x in fresh if x not in self.known]
        if fresh:
            self.known |= self._learn(fresh)
        for i, found, missing in cut:
            for at, piece in missing.items():
                found[at] = self.known[piece]
            out[i] = b"".join(found)
        for piece in fresh:
            if len(piece) > KEY_LENGTH:
                del self.known[piece]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        return self.encode_all([text])[0]


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def piece_tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


class Packer:
    """Windows being filled. A piece is (doc_id, start, ids, doc_tokens); emit gets (sequence id, pieces)."""

    def __init__(self, window: int, emit, first_id: int = 0, max_open: int = 4096):
        self.window, self.emit, self.next_id, self.max_open = window, emit, first_id, max_open
        self.level_counts = np.zeros(window + 1, np.int64)
        self.at_level: dict[int, list[list]] = {}
        self.open = 0

    def _send(self, pieces: list) -> None:
        self.emit(self.next_id, pieces)
        self.next_id += 1

    def add(self, doc_id, ids: bytes) -> None:
        total, width = len(ids) // 4, self.window * 4
        whole = len(ids) // width * width
        for at in range(0, whole, width):
            self._send([(doc_id, at // 4, ids[at : at + width], total)])
        if len(ids) > whole:
            self.place((doc_id, whole // 4, ids[whole:], total))

    def place(self, piece: tuple) -> None:
        size, window, counts = len(piece[2]) // 4, self.window, self.level_counts
        best, level = 2 * int(counts[size]) + 1, 0
        levels = np.flatnonzero(counts[1 : window - size + 1]) + 1
        if len(levels):
            change = 2 * (counts[levels + size] - counts[levels]) + 2
            if levels[-1] + size == window:
                change[-1] = 1 - 2 * counts[levels[-1]]
            at = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[at] <= best:
                level = int(levels[at])
        if level:
            pieces = self.at_level[level].pop()
            counts[level] -= 1
            self.open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == window:
            self._send(pieces)
            return
        self.at_level.setdefault(level + size, []).append(pieces)
        counts[level + size] += 1
        self.open += 1
        if self.open > self.max_open:
            self.merge()

    def merge(self) -> None:
        """Cut the emptiest windows to fill the fullest. The one that stays partial remains open."""
        order = sorted(((h, p) for h, windows in self.at_level.items() for p in windows), key=lambda x: -x[0])
        self.level_counts[:], self.at_level, self.open = 0, {}, 0
        fullest, last = 0, len(order) - 1
        while fullest < last:
            level, pieces = order[fullest]
            gap = self.window - level
            while gap and fullest < last:
                source = order[last][1]
                if not source:
                    last -= 1
                    continue
                doc_id, start, ids, total = source.pop()
                take = min(gap, len(ids) // 4)
                pieces.append((doc_id, start, ids[: take * 4], total))
                if take * 4 < len(ids):
                    source.append((doc_id, start + take, ids[take * 4 :], total))
                gap -= take
            if gap:
                order[fullest] = (self.window - gap, pieces)
                break
            self._send(pieces)
            fullest += 1
        if order and order[fullest][1]:
            pieces = order[fullest][1]
            level = sum(len(x[2]) for x in pieces) // 4
            if level == self.window:
                self._send(pieces)
            else:
                self.at_level, self.open = {level: [pieces]}, 1
                self.level_counts[level] = 1

    def close(self) -> None:
        """Merge, then cut what is left into power-of-two lengths."""
        self.merge()
        for level, windows in self.at_level.items():
            pieces = windows[0][::-1]
            for bit in reversed(range(level.bit_length())):
                need, out = level & 1 << bit, []
                while need:
                    doc_id, start, ids, total = pieces.pop()
                    take = min(need, len(ids) // 4)
                    out.append((doc_id, start, ids[: take * 4], total))
                    if take * 4 < len(ids):
                        pieces.append((doc_id, start + take, ids[take * 4 :], total))
                    need -= take
                if out:
                    self._send(out)
        self.level_counts[:], self.at_level, self.open = 0, {}, 0


def _portions(block: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch, some BATCH_CHARS at a time."""
    ids, first, size, texts = block.column(0).to_pylist(), 0, 0, []
    for at, value in enumerate(block.column(1)):
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= BATCH_CHARS or at + 1 == len(ids):
            yield ids[first : at + 1], texts
            first, size, texts = at + 1, 0, []


def pack(docs: DataFrame, window: int = 4096, end_id: int = 2, path: str | None = None, max_open: int = 4096, key: str = "doc_id", text: str = "text", known: int = KNOWN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset. Every id of a document lies in exactly one piece. known: how many
    pre-tokens a worker remembers, which costs memory and saves time; the rows are the same."""
    path = path or tokenizer_file("word_bpe_49k.json")

    def run(batches):
        tokenizer = piece_tokenizer(path)
        tokenizer.most = known
        end = array("I", [end_id]).tobytes()
        rows: list[tuple] = []
        held = [0]

        def emit(sequence, pieces):
            offset = 0
            for doc_id, start, ids, total in pieces:
                length = len(ids) // 4
                rows.append((doc_id, start, length, ids, total, sequence, offset))
                offset += length
            held[0] += offset * 4

        def batch():
            columns = list(zip(*rows))
            rows.clear()
            held[0] = 0
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        packer = Packer(window, emit, TaskContext.get().partitionId() << 32, max_open)
        for block in batches:
            for doc_ids, texts in _portions(block):
                for doc_id, ids in zip(doc_ids, tokenizer.encode_all(texts)):
                    packer.add(doc_id, ids + end)
                    if held[0] > BATCH_BYTES:
                        yield batch()
        packer.close()
        if rows:
            yield batch()
        tokenizer.older = {}
        pa.default_memory_pool().release_unused()  # the worker may serve other stages

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)


def op8_sum_of_squares(spark, sf_dir) -> DataFrame:
    """Where every piece of every document went, with a checksum of its ids."""
    pieces = pack(table(spark, sf_dir, "documents", "doc_id", "text"), known=KNOWN_ALONE)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
