"""Words of a text and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Default entries of each of a memo's two generations; longer keys than KEY_LENGTH are computed anew each time.
CACHE_ENTRIES, KEY_LENGTH = 200_000, 64


class Memo(dict):
    """A bounded memory of a function's results. When it is full it becomes the older generation, and
    what is asked for again moves to the new one; two generations are kept."""

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries, self.older = make, entries, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= KEY_LENGTH:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


#: Bytes hashed at a time; words of more bytes than LONG_WORD are hashed one by one.
HASH_BYTES, LONG_WORD = 1 << 20, 4096
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers scattered one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the bytes of texts that begin at offsets (the last one: the end), and where the words begin."""
    data = _LOWER[data]
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~space & (np.concatenate(([True], space[:-1])) | edge[:-1]))
    stops = np.flatnonzero(~space & (np.concatenate((space[1:], [True])) | edge[1:])) + 1
    lengths = stops - starts
    out = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)
    left = np.flatnonzero(lengths <= LONG_WORD)
    done = 0
    while len(left):
        part = eights[starts[left] + done].view("<u8").ravel()
        short = np.minimum(lengths[left] - done, 8).astype(np.uint64)
        part &= np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - short) * np.uint64(8))
        out[left] = mixed(out[left] ^ part)
        done += 8
        left = left[lengths[left] > done]
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        import xxhash

        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : stops[i]].tobytes())
    return out, starts


def hashed_words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, counts) of some texts after another of a column, null ones without words: 64-bit hashes
    of the runs of `[^\\x20\\x09-\\x0D]`, A-Z lower-cased, and how many each text has."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + HASH_BYTES, side="right")) - 1)
        own = offsets[first : last + 1] - offsets[first]
        found, starts = _hashes(data[offsets[first] : offsets[last]], own)
        yield found, np.diff(np.searchsorted(starts, own))
        first = last


def word_hashes(text: str) -> np.ndarray:
    """The hashes of one text's words."""
    data = np.frombuffer(text.encode(), np.uint8)
    return _hashes(data, np.array([0, len(data)]))[0]
