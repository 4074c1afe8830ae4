"""Documents scored by a hierarchical Pitman-Yor language model whose seating is Gibbs-sampled.

Every word that stands before another has a restaurant, and so has the start of a document. All of them
share the unigram restaurant as their parent, whose own parent is uniform over the known words and one
unknown. Where Settings.every is false, only the contexts - 2 most frequent words have a restaurant of
their own, and all others share one.

Counting. The restaurants are dealt to parts by their word's hash. Tasks count the (previous word, word)
pairs of their documents, and each part adds up its own: one row of packed numbers for a part, so Spark
moves few rows whatever the number of pairs. A part lists each of its words once; its pairs, sorted, are
steps of some two bytes. Seating. In a sweep, the number of tables t of a word's c
customers in a restaurant is drawn from its conditional given all other tables,
P(t) ~ S(c, t) * prod(theta + discount * (T + j), j < t) * parent(word) ** t, with S the generalised
Stirling numbers; the tables are the parent's customers, whose tables are drawn next. One customer has
one table, so only pairs that occur twice or more take part. The unigram restaurant is dealt to owners by
the words' hashes: parts tell them the tables of their words, owners draw and answer. Customers of one
word in one restaurant beyond STIRLING are seated in blocks by the predictive rule. Words are independent
given the restaurants' totals, which are those of the sweep before. Predictive probabilities are averaged
over the sweeps after burn_in.

Scoring. The base probabilities of the `head` most frequent words and the probabilities of at most
NEAR_PAIRS most frequent pairs go to every task; they only save traffic. All other tokens of a document go
to the part of the word before them, which asks the owners for the words that are not among the head and
sends back each document's sum. On that way a pair of two head words is the number of both among the head,
any other one a hash; sorted, they travel as steps. Pairs of documents that training lacks are listed without customers.

Cases: a null or empty text is the end token alone; a null id reads as the empty string, whose crc32
is 0, and so is held out; rows that repeat an id are scored and learnt each on its own; with no
training documents every probability is the uniform one; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import materialize, release, table
from freshet.llm.text import hashed_words, mixed

#: Tokens counted at a time; rows of an output batch; customers seated by the exact conditional.
CHUNK, BATCH, STIRLING = 2_000_000, 50_000, 512
#: Bytes of text for each part of the restaurants; pairs whose probabilities go to every task.
PART_BYTES, NEAR_PAIRS = 24 << 20, 3 << 19
#: The end token, the start of a document and the pool of contexts: numbers that are no word's hash but by a chance of 2**-64 a word.
END, START, OTHERS = np.int64(0x2D06800538D394C2), np.int64(0x51B3C1F0A94D6E27), np.int64(0x1F83D9ABFB41BD6B)
#: The type of a restaurant's number in Model.words.
PLACE = np.uint16
#: Packed numbers on their way to a place, and what kinds there are, in the order in which a place reads them.
PARCEL_NAMES = ["place", "kind", "origin", "a", "b", "c", "d", "e", "f"]
PARCEL = "place long, kind int, origin long, a binary, b binary, c binary, d binary, e binary, f binary"
PAIRS, SEATS, WORDS, ASKED, ANSWER, POSTED, OWN, SUMS = range(8)
#: Pairs of some documents: contexts, words of each, words, customers. Seats: contexts, words of each, their pairs of one customer, words, customers, tables.
_PAIR_TYPES = (np.int64, np.uint32, np.int64, np.uint32)
_SEAT_TYPES = (np.int64, np.uint32, np.uint32, np.int64, np.uint32, np.uint32)
#: Marks the numbers of pairs that are hashes.
HASHED = np.uint64(1 << 63)


@dataclass(frozen=True)
class Settings:
    """every: each previous word has its restaurant, which holds unless another number of contexts is
    asked for; else `contexts` restaurants (at most 65,536). Words known to every task, sweeps, and the
    two levels' parameters."""

    contexts: int = 1024
    head: int = 1 << 18
    sweeps: int = 4
    burn_in: int = 1
    discount: float = 0.75
    strength: float = 10.0
    root_discount: float = 0.6
    root_strength: float = 100.0
    seed: int = 11
    every: bool | None = None

    def __post_init__(self):
        if self.every is None:
            object.__setattr__(self, "every", self.contexts == Settings.contexts)


@dataclass
class Totals:
    """Customers and tables of the context restaurants, and tables of the unigram restaurant."""

    customers: np.ndarray
    tables: np.ndarray
    root_tables: float

    @property
    def root_customers(self) -> float:
        return float(self.tables.sum())


@dataclass
class Model:
    """What training leaves: the parts' pairs and sampled seats, the owners' words with their samples,
    the root's customers and tables in each, and the most frequent words."""

    settings: Settings
    docs: DataFrame
    n: int
    v: int
    named: np.ndarray | None
    parts: int
    owners: int
    pairs: DataFrame
    seats: DataFrame
    roots_by_word: DataFrame
    roots: list[tuple[float, float]]

    def __post_init__(self):
        self.order, self.head_rank, self.often, self.parents = _near(self)

    @cached_property
    def words(self) -> DataFrame:
        """A row for each word: places, customers and tables there (binary; all samples, one after
        another), root_tables, often. A place is the rank of the previous word among the contexts - 2
        most frequent, contexts - 2 for all others together, contexts - 1 for the start."""
        how, samples = self.settings, len(self.roots)
        order, rank = self.order, self.head_rank

        def listed(batches):
            for place, kind, _, data in _parcels(batches):
                if kind == PAIRS:
                    own, wide, words, customers, known = _pairs_of(data)
                    words = known[words]
                    continue
                at, near = _found(order, own)
                places = np.where(near & (rank[at] < how.contexts - 2), rank[at], how.contexts - 2) if len(order) else np.full(len(own), how.contexts - 2)
                places = np.repeat(np.where(own == START, how.contexts - 1, places), wide)
                tables = _all_tables(customers, _array(data[5], np.uint32), samples).astype(np.int64)
                known = customers > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[known]), pa.array(places[known]), pa.array(customers[known].astype(np.int64)), _rows_of(tables[:, known].T)],
                    names=["word", "place", "customers", "tables"],
                )

        def rooted(batches):
            for _, _, _, data in _parcels(batches):
                words, often = _array(data[0], np.int64), _array(data[1], np.int64)
                tables = _array(data[3], np.uint32).reshape(samples, 2, -1)[:, 1].astype(np.int64)
                known = often > 0
                yield pa.RecordBatch.from_arrays([pa.array(words[known]), pa.array(often[known]), _rows_of(tables[:, known].T)], names=["word", "often", "root_tables"])

        def packed(batches):
            for batch in batches:
                places, customers, tables = [], [], []
                for seats in batch.column(1).to_pylist():
                    where, at = np.unique([x["place"] for x in seats], return_inverse=True)
                    each = np.zeros((samples, len(where)), np.int64)
                    np.add.at(each.T, at, np.array([np.frombuffer(x["tables"], np.int64) for x in seats]))
                    places.append(where.astype(PLACE).tobytes())
                    customers.append(np.bincount(at, [x["customers"] for x in seats]).astype(np.int64).tobytes())
                    tables.append(each.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places), pa.array(customers), pa.array(tables)], names=["word", "places", "customers", "tables"])

        seats = _met(self.parts, self.pairs, self.seats).mapInArrow(listed, "word long, place long, customers long, tables binary")
        seats = seats.groupBy("word").agg(F.collect_list(F.struct("place", "customers", "tables")))
        roots = self.roots_by_word.mapInArrow(rooted, "word long, often long, root_tables binary")
        return seats.mapInArrow(packed, "word long, places binary, customers binary, tables binary").join(roots, "word")

    @cached_property
    def averaged(self) -> list[Totals]:
        """Totals of the averaged sweeps, by the places of words."""
        how, samples = self.settings, len(self.roots)

        def run(batches):
            sums = np.zeros((samples + 1, how.contexts))
            for batch in batches:
                places, wide = _flat(batch.column("places"), PLACE)
                customers, history = _flat(batch.column("customers"), np.int64)[0], _flat(batch.column("tables"), np.int64)[0]
                begin, owner = np.cumsum(wide) - wide, np.repeat(np.arange(len(wide)), wide)
                sums[0] += np.bincount(places, customers, how.contexts)
                for s in range(samples):
                    sums[s + 1] += np.bincount(places, history[(begin * samples + wide * s)[owner] + np.arange(len(places)) - begin[owner]], how.contexts)
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()])], names=["sums"])

        customers, *tables = sum(np.frombuffer(r[0]).reshape(samples + 1, -1) for r in self.words.mapInArrow(run, "sums binary").collect())
        return [Totals(customers, t, root) for t, (_, root) in zip(tables, self.roots)]


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(held_out().alias("held_out"), "text", F.col("doc_id").cast("long").alias("doc_id"))


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens, sizes) of some texts after another: word hashes, each text's closed by the end token."""
    for hashes, counts in hashed_words(column):
        stops = np.cumsum(counts + 1) - 1
        tokens = np.empty(len(hashes) + len(counts), np.int64)
        word = np.ones(len(tokens), bool)
        word[stops] = False
        tokens[word], tokens[stops] = hashes.view(np.int64), END
        yield tokens, counts + 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, tuple]]:
    """Tokens, sizes and (ids, held out, has an id) of some documents of _read() after another."""
    held, size = [], 0
    for batch in batches:
        low, ids = 0, batch.column(2)
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        rows = ids.fill_null(0).to_numpy(), batch.column(0).to_numpy(zero_copy_only=False), valid
        for tokens, sizes in _texts(batch.column(1)):
            held.append((tokens, sizes, *(x[low : low + len(sizes)] for x in rows)))
            size, low = size + len(tokens), low + len(sizes)
            if size >= CHUNK:
                tokens, sizes, *rest = map(np.concatenate, zip(*held))
                yield tokens, sizes, rest
                held, size = [], 0
    if held:
        tokens, sizes, *rest = map(np.concatenate, zip(*held))
        yield tokens, sizes, rest


def _blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: the bytes of values cut at ends (counts of elements)."""
    offsets = np.concatenate(([0], ends * values.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a binary column, and how many each row has (null: none), without a copy."""
    if not len(column):
        return np.empty(0, kind), np.empty(0, np.int64)
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    if values.ctypes.data % np.dtype(kind).itemsize:
        values = values.copy()
    return values.view(kind), np.diff(ends) // np.dtype(kind).itemsize


def counts(docs: DataFrame) -> DataFrame:
    """(word, customers): how often each word hash occurs in training."""

    def run(batches):
        for tokens, _, _ in _chunks(batches):
            words, often = np.unique(tokens, return_counts=True)
            for at in range(0, len(words), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + BATCH]), pa.array(often[at : at + BATCH])], names=["word", "customers"])

    return _read(docs.where(~held_out())).mapInArrow(run, "word long, customers long").groupBy("word").agg(F.sum("customers").alias("customers"))


def _contexts(tokens: np.ndarray, sizes: np.ndarray, named: np.ndarray | None) -> np.ndarray:
    """The restaurant of each token: the hash of the word before it. named: hashes, sorted, of the only
    words that have a restaurant of their own (None: every word has)."""
    before = np.concatenate(([START], tokens[:-1]))
    if named is not None:
        at = np.minimum(np.searchsorted(named, before), len(named) - 1) if len(named) else None
        before = np.where(named[at] == before, before, OTHERS) if len(named) else np.full(len(before), OTHERS)
    before[np.cumsum(sizes) - sizes] = START
    return before


def _scattered(words: np.ndarray) -> np.ndarray:
    return mixed(words.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _pair_keys(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(_scattered(contexts) + words.view(np.uint64))


def _share_of(scattered: np.ndarray, parts: int) -> np.ndarray:
    """Which of `parts` equal ranges of 64-bit numbers each number is in."""
    return ((scattered >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(len(values), 1), bool), values[1:] != values[:-1])))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each run of equal ones, and the runs' lengths."""
    at = _firsts(values)
    return values[at], np.diff(np.append(at, len(values)))


def _found(order: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted array, and whether it is there."""
    if not len(order):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(order, keys), len(order) - 1)
    return at, order[at] == keys


def _parcel(place: int, kind: int, origin: int = 0, *arrays: np.ndarray) -> pa.RecordBatch:
    """One row of PARCEL: arrays on their way to a place."""
    data = [pa.array([x.tobytes()], pa.binary()) for x in arrays] + [pa.array([None], pa.binary())] * (6 - len(arrays))
    return pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([kind], pa.int32()), pa.array([origin], pa.int64()), *data], names=PARCEL_NAMES)


def _parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, list]]:
    """(place, kind, origin, buffers) of each row."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), [batch.column(k)[i] for k in range(3, 9)]


def _array(value, kind) -> np.ndarray:
    """The numbers of a binary value, without a copy where they are aligned."""
    data = np.frombuffer(value.as_buffer(), np.uint8)
    return (data.copy() if data.ctypes.data % np.dtype(kind).itemsize else data).view(kind)


def _planes(values: np.ndarray) -> np.ndarray:
    """The first bytes of all numbers, then the second ones, and so on up to the last that one needs:
    what they have alike packs well."""
    wide = -(-int(values.max()).bit_length() // 8) if len(values) else 0
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize)[:, :wide].T)


def _unplaned(value, kind, n: int) -> np.ndarray:
    """The n numbers of _planes()."""
    planes = _array(value, np.uint8)
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    if n:
        planes = planes.reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view(kind).ravel()


def _steps(numbers: np.ndarray) -> np.ndarray:
    """Planes of the steps between sorted unsigned numbers."""
    return _planes(np.diff(numbers, prepend=np.uint64(0)))


def _stepped(value, n: int) -> np.ndarray:
    """The n numbers of _steps()."""
    return np.cumsum(_unplaned(value, np.uint64, n), dtype=np.uint64)


def _listed(place: int, contexts: np.ndarray, words: np.ndarray, often: np.ndarray) -> pa.RecordBatch:
    """A part's row of different pairs, those of a context together: contexts, words of each, steps
    between the pairs' numbers (sorted by word in each context), customers, and the part's words."""
    own, wide = _runs(contexts)
    known, at = np.unique(words.view(np.uint64), return_inverse=True)
    numbers = np.repeat(np.arange(len(own)), wide) * len(known) + at
    sorts = np.argsort(numbers)
    counts = np.array([len(words), len(known)])
    return _parcel(place, PAIRS, 0, own, wide.astype(np.uint32), _steps(numbers[sorts].view(np.uint64)), _planes(often[sorts].astype(np.uint32)), _steps(known), counts)


def _pairs_of(data: list) -> tuple[np.ndarray, ...]:
    """Of a row of _listed(): contexts, words of each, places of the words, customers, the part's words (sorted as unsigned)."""
    n, words = _array(data[5], np.int64).tolist()
    at = (_stepped(data[2], n) % np.uint64(max(words, 1))).view(np.int64)
    return _array(data[0], np.int64), _array(data[1], np.uint32), at, _unplaned(data[3], np.uint32, n), _stepped(data[4], words).view(np.int64)


def _met(places: int | None, *frames: DataFrame) -> DataFrame:
    """The rows of all frames, each place's together and in the order of their kinds. places: how many
    there are, each a task of its own; None: any."""
    rows = frames[0]
    for more in frames[1:]:
        rows = rows.unionByName(more)
    rows = rows.repartitionById(places, F.pmod("place", F.lit(places)).cast("int")) if places else rows.repartition("place")
    return rows.sortWithinPartitions("place", "kind", "origin")


def _all_tables(customers: np.ndarray, history: np.ndarray, samples: int) -> np.ndarray:
    """Tables of a part's pairs in each sample, from those of the pairs with two customers or more."""
    tables = np.repeat((customers > 0).astype(np.uint32)[None], samples, axis=0)
    tables[:, customers > 1] = history.reshape(samples, -1)
    return tables


def _cut(scattered: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, begin, end) of the parts that have some of the sorted numbers."""
    places, counts = _runs(_share_of(scattered, parts))
    ends = np.cumsum(counts)
    yield from zip(places.tolist(), (ends - counts).tolist(), ends.tolist())


def _compact(contexts: np.ndarray, words: np.ndarray, often: np.ndarray):
    """The different pairs by their contexts' scattered hash, then by their own, with the sum of often."""
    keys = _pair_keys(contexts, words)
    sorts = np.argsort(keys, kind="stable")
    new = _firsts(keys[sorts])
    often, firsts = np.add.reduceat(often[sorts], new) if len(new) else often[:0], sorts[new]
    contexts, words = contexts[firsts], words[firsts]
    sorts = np.argsort(_scattered(contexts), kind="stable")
    return contexts[sorts], words[sorts], often[sorts]


def pairs(docs: DataFrame, named: np.ndarray | None, parts: int, listed: DataFrame | None = None) -> DataFrame:
    """Rows of _listed(), one for each of `parts` ranges of contexts: the pairs and how often each
    occurs in training; pairs that only held-out documents have count 0. listed: rows of other
    documents, to which these add their pairs without a count."""

    def counted(batches):
        for tokens, sizes, rows in _chunks(batches):
            training = np.repeat(~rows[1] & first, sizes).astype(np.int64)
            contexts, words, often = _compact(_contexts(tokens, sizes, named), tokens, training)
            for part, low, high in _cut(_scattered(contexts), parts):
                own, wide = _runs(contexts[low:high])
                yield _parcel(part, PAIRS, 0, own, wide.astype(np.uint32), words[low:high], often[low:high].astype(np.uint32))

    def added(batches):
        place, held, size = None, [], 0
        for part, _, _, data in _parcels(batches):
            if place is not None and part != place:
                yield closed(place, held)
                held, size = [], 0
            place = part
            if data[5].is_valid:
                own, wide, at, often, words = _pairs_of(data)
                words = words[at]
            else:
                own, wide, words, often = (_array(x, k) for x, k in zip(data, _PAIR_TYPES))
            held.append((np.repeat(own, wide), words, often.astype(np.int64)))
            size += len(words)
            if size > 2 * CHUNK and size > 2 * len(held[0][0]):
                held = [_compact(*joined(held))]
                size = len(held[0][0])
        if held:
            yield closed(place, held)

    def joined(held):
        columns = [list(x) for x in zip(*held)]
        held.clear()  # a column's pieces go as soon as they are joined
        return [np.concatenate(columns.pop(0)) for _ in range(3)]

    def closed(place, held):
        return _listed(place, *_compact(*joined(held)))

    first = listed is None
    rows = _read(docs).mapInArrow(counted, PARCEL)
    return _met(parts, *([rows] if first else [rows, listed])).mapInArrow(added, PARCEL)


def _seats(found: DataFrame) -> DataFrame:
    """Of the pairs that occur twice or more: contexts, their pairs, their pairs that occur once, words,
    customers, tables (one each). A pair that occurs once has one table whatever is drawn."""

    def run(batches):
        for place, _, _, data in _parcels(batches):
            own, wide, at, often, words = _pairs_of(data)
            owner = np.repeat(np.arange(len(own)), wide)
            many, once = np.bincount(owner[often > 1], minlength=len(own)), np.bincount(owner[often == 1], minlength=len(own))
            kept = many > 0
            yield _parcel(place, SEATS, 0, own[kept], many[kept].astype(np.uint32), once[kept].astype(np.uint32), words[at[often > 1]], often[often > 1], np.ones(int(many.sum()), np.uint32))

    return found.mapInArrow(run, PARCEL)


def _opened(found: DataFrame, owners: int) -> DataFrame:
    """One row for each range of words: words, customers, tables of pairs that occur once, root tables
    (no sample yet), root customers."""

    def run(batches):
        for place, _, _, data in _parcels(batches):
            _, _, at, often, words = _pairs_of(data)
            # sums of less than 2**53 customers are exact
            sums, once = np.bincount(at, often, len(words)).astype(np.int64), np.bincount(at[often == 1], minlength=len(words))
            for part, low, high in _cut(words.view(np.uint64), owners):
                yield _parcel(part, WORDS, place, words[low:high], sums[low:high], once[low:high].astype(np.uint32))

    def added(batches):
        place, held, size = None, [], 0
        for part, _, _, data in _parcels(batches):
            if place is not None and part != place:
                yield _parcel(place, WORDS, 0, *summed(held))
                held, size = [], 0
            place = part
            held.append((_array(data[0], np.int64), _array(data[1], np.int64), _array(data[2], np.uint32).astype(np.int64)))
            size += len(held[-1][0])
            if size > CHUNK and size > 2 * len(held[0][0]):
                held = [summed(held)]
                size = len(held[0][0])
        if held:
            yield _parcel(place, WORDS, 0, *summed(held))

    def summed(held):
        words, *sums = map(np.concatenate, zip(*held))
        sorts = np.argsort(words.view(np.uint64))
        words = words[sorts]
        new = _firsts(words)
        return words[new], *(np.add.reduceat(x[sorts], new) for x in sums)

    return _met(owners, found.mapInArrow(run, PARCEL)).mapInArrow(added, PARCEL)


def _asked(seats: DataFrame, owners: int) -> DataFrame:
    """To each range of words: the words of a range of contexts that have seats, and their newest tables there."""

    def run(batches):
        for place, _, _, data in _parcels(batches):
            words, tables = _array(data[3], np.int64), _array(data[5], np.uint32)
            tables = tables[len(tables) - len(words) :]
            sorts = np.argsort(words.view(np.uint64))
            words = words[sorts]
            new = _firsts(words)
            if len(new):
                sums, words = np.add.reduceat(tables[sorts].astype(np.int64), new), words[new]
                for part, low, high in _cut(words.view(np.uint64), owners):
                    yield _parcel(part, ASKED, place, words[low:high], sums[low:high].astype(np.uint32))

    return seats.mapInArrow(run, PARCEL)


def _root_seats(owners: int, words: DataFrame, asked: DataFrame, totals: tuple[float, float] | None, keep: bool, number: int, v: int, how: Settings) -> DataFrame:
    """The root's tables drawn anew (totals None: one a word). Rows: words with their samples of root
    customers and root tables; answers to whoever asked; sums of a range (customers, tables)."""

    def run(batches):
        place, own, questions = None, None, []
        logs = stirling(how.root_discount)
        for part, kind, origin, data in _parcels(batches):
            if part != place:
                if place is not None:
                    yield from closed(place, own, questions, logs)
                place, own, questions = part, None, []
            if kind == WORDS:
                own = data
            else:
                questions.append((origin, _array(data[0], np.int64), _array(data[1], np.uint32)))
        if place is not None:
            yield from closed(place, own, questions, logs)

    def closed(place, own, questions, logs):
        words, once = _array(own[0], np.int64), _array(own[2], np.int64)
        root = once.copy()
        places = []
        for _, asked_words, tables in questions:
            places.append(np.searchsorted(words.view(np.uint64), asked_words.view(np.uint64)))
            root[places[-1]] += tables
        if totals is None:
            tables, history = np.minimum(root, 1), np.empty((0, 2, len(words)), np.uint32)
        else:
            history = _array(own[3], np.uint32).reshape(-1, 2, len(words))
            rest = how.root_strength + how.root_discount * np.maximum(totals[1] - history[-1, 1], 0)
            tables = seat(root, rest, np.full(len(words), 1 / (v + 1)), how.root_discount, logs, words, how.seed << 16 | number)
        newest = np.stack((root, tables))[None].astype(np.uint32)
        yield _parcel(place, WORDS, 0, words, _array(own[1], np.int64), once, np.concatenate((history, newest)) if keep else newest)
        for (origin, *_), at in zip(questions, places):
            yield _parcel(origin, ANSWER, place, newest[0, 0, at], newest[0, 1, at])
        yield _parcel(place, SUMS, 0, np.array([root.sum(), tables.sum()], float))

    return _met(owners, words, asked).mapInArrow(run, PARCEL)


def _sat(parts: int, seats: DataFrame, answers: DataFrame, totals: tuple[float, float], keep: bool, number: int, v: int, how: Settings) -> DataFrame:
    """The tables of all pairs with two customers or more, drawn anew; keep: they join the samples."""

    def run(batches):
        place, own, answered = None, None, []
        logs = stirling(how.discount)
        for part, kind, _, data in _parcels(batches):
            if part != place:
                if place is not None:
                    yield closed(place, own, answered, logs)
                place, own, answered = part, None, []
            if kind == SEATS:
                own = data
            else:
                answered.append((_array(data[0], np.uint32), _array(data[1], np.uint32)))
        if place is not None:
            yield closed(place, own, answered, logs)

    def closed(place, own, answered, logs):
        contexts, wide, once, words, customers, history = (_array(x, k) for x, k in zip(own, _SEAT_TYPES))
        tables = history[len(history) - len(words) :].astype(np.int64)
        if len(words):
            # answers come in the order of the words' ranges, which is that of the words
            _, at = np.unique(words.view(np.uint64), return_inverse=True)
            root, root_tables = (np.concatenate(x).astype(np.int64)[at] for x in zip(*answered))
            owner = np.repeat(np.arange(len(contexts)), wide)
            total = np.bincount(owner, tables, len(contexts)) + once
            less = np.maximum(root - tables, 0)
            uniform = (how.root_strength + how.root_discount * totals[1]) / (v + 1)
            parent = (less - how.root_discount * np.minimum(root_tables, less) + uniform) / (how.root_strength + totals[0])
            others = how.strength + how.discount * np.maximum(total[owner] - tables, 0)
            keys = _pair_keys(contexts[owner], words).view(np.int64)
            tables = seat(customers.astype(np.int64), others, parent, how.discount, logs, keys, how.seed << 16 | number)
        tables = tables.astype(np.uint32)
        return _parcel(place, SEATS, 0, contexts, wide, once, words, customers, np.concatenate((history, tables)) if keep else tables)

    return _met(parts, seats, answers).mapInArrow(run, PARCEL)


def _sum_of(rows: DataFrame) -> tuple[float, float]:
    """Root customers and root tables: two numbers for each range of words."""
    got = [np.frombuffer(r[0]) for r in rows.where(F.col("kind") == SUMS).select("a").collect()]
    return tuple(np.sum(got, axis=0).tolist()) if got else (0.0, 0.0)


def _level(often: np.ndarray) -> np.ndarray:
    """Counts by eighths of a power of two."""
    return np.floor(8 * np.log2(np.maximum(often, 1))).astype(np.int64)


def _least(levels: DataFrame, most: int) -> int:
    """The least level such that no more than `most` numbers have it or a higher one."""
    counts = np.zeros(8 * 64, np.int64)
    for r in levels.collect():
        counts[r["level"]] += r["n"]
    above = np.cumsum(counts[::-1])[::-1]
    return int(np.argmax(np.append(above, 0) <= most))


def _levels(rows: DataFrame, column: int, kind) -> DataFrame:
    def run(batches):
        counts = np.zeros(8 * 64, np.int64)
        for _, _, _, data in _parcels(batches):
            often = _array(data[column], kind)
            counts += np.bincount(_level(often[often > 0]), minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], names=["level", "n"])

    return rows.mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, how: Settings = Settings()) -> Model:
    """The model of all documents (doc_id, text) that are not held out. Pairs that only held-out ones
    have are listed with no customers, so that each pair of docs can be looked up."""
    named = None
    if not how.every:
        often = counts(docs)
        named = np.sort(np.array([r[0] for r in often.orderBy(F.desc("customers"), "word").limit(how.contexts - 2).select("word").collect()], np.int64))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    parts = max(1, -(-size // PART_BYTES))
    owners = max(1, parts // 2)
    found = materialize(pairs(docs, named, parts), "pairs")
    words = materialize(_opened(found, owners), "words")
    _swept(docs.sparkSession)

    def sums(batches):
        n = v = 0
        for _, _, _, data in _parcels(batches):
            often = _array(data[1], np.int64)
            n, v = n + int(often.sum()), v + int((often > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([v])], names=["n", "v"])

    n, v = words.mapInArrow(sums, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    seats, roots, totals = materialize(_seats(found), "seats"), [], None
    for number in range(how.sweeps + 1):
        # the root's tables of the sweep before, then the restaurants' tables of this one
        done = number - 1
        rows = materialize(_root_seats(owners, words, _asked(seats, owners), totals, done > how.burn_in, done, v, how), "words")
        release(words)
        words, totals = rows.where(F.col("kind") == WORDS), _sum_of(rows)
        words._freshet_path = rows._freshet_path
        if done >= how.burn_in:
            roots.append(totals)
        if number < how.sweeps:
            before, seats = seats, materialize(_sat(parts, seats, rows.where(F.col("kind") == ANSWER), totals, number > how.burn_in, number, v, how), "seats")
            release(before)
        _swept(docs.sparkSession)
    return Model(how, docs, n, v, named, parts, owners, found, seats, words, roots)


def _swept(spark) -> None:
    """Let Spark delete the shuffle files of frames that are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _chances(owner: np.ndarray, contexts: int, once, customers: np.ndarray, tables: np.ndarray, parents: np.ndarray, how: Settings) -> np.ndarray:
    """Probabilities of pairs, averaged over the samples. once: the contexts' pairs that are not listed,
    of one customer each; tables and parents: one row for each sample."""
    strength = how.strength + np.bincount(owner, customers, contexts) + once
    out = customers - how.discount * tables.mean(axis=0)
    for own, parent in zip(tables, parents):
        passed = how.strength + how.discount * (np.bincount(owner, own, contexts) + once)
        out += passed[owner] * parent / len(tables)
    return out / strength[owner]


def _near(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent words, at most settings.head and the driver's to keep: hashes, sorted, ranks,
    customers, and probabilities in the root."""
    how = model.settings
    least = _least(_levels(model.roots_by_word, 1, np.int64), how.head)

    def run(batches):
        for _, _, _, data in _parcels(batches):
            words, often, root = _array(data[0], np.int64), _array(data[1], np.int64), _array(data[3], np.uint32)
            kept = (often > 0) & (_level(often) >= least)
            parents = model_root(root.reshape(-1, 2, len(words))[:, :, kept])
            yield pa.RecordBatch.from_arrays([pa.array(words[kept]), pa.array(often[kept]), _rows_of(parents.T)], names=["word", "often", "parents"])

    model_root = _root_chance(model)
    got = model.roots_by_word.mapInArrow(run, "word long, often long, parents binary").toArrow()
    words, often = got.column("word").to_numpy(), got.column("often").to_numpy()
    parents = np.frombuffer(b"".join(got.column("parents").to_pylist())).reshape(len(words), len(model.roots))
    by = np.lexsort((words, -often))
    rank = np.empty(len(words), np.int64)
    rank[by] = np.arange(len(words))
    sorts = np.argsort(words)
    return words[sorts], rank[sorts], often[sorts], np.ascontiguousarray(parents[sorts].T)


def _rows_of(values: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    return _blobs(np.ascontiguousarray(values).ravel(), np.arange(1, len(values) + 1) * values.shape[1])


def _root_chance(model: Model):
    """A function from samples x (root customers, root tables) x words to samples x words probabilities."""
    how, v, roots = model.settings, model.v, np.array(model.roots, float).reshape(-1, 2, 1)

    def chance(root):
        uniform = (how.root_strength + how.root_discount * roots[:, 1]) / (v + 1)
        return (root[:, 0] - how.root_discount * root[:, 1] + uniform) / (how.root_strength + roots[:, 0])

    return chance


def _numbers(size: int, contexts: np.ndarray, before: np.ndarray, usual: np.ndarray, words: np.ndarray, at: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Numbers of pairs: of two of the `size` near words from their places (before, where usual; at,
    where near), of others a hash. The former are small, so that sorted ones are near one another."""
    out = before.astype(np.uint64)
    out *= np.uint64(size)
    out += at.view(np.uint64)
    rest = np.flatnonzero(~(usual & near))
    out[rest] = _pair_keys(contexts[rest], words[rest]) | HASHED
    return out


def _near_pairs(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, sorted, and log10 probabilities of the most frequent pairs of near words, at most NEAR_PAIRS."""
    how, order, parents = model.settings, model.order, model.parents
    least = _least(_levels(model.seats, 4, np.uint32), NEAR_PAIRS)
    samples = len(model.roots)

    def run(batches):
        for _, _, _, data in _parcels(batches):
            contexts, wide, once, words, customers, history = (_array(x, k) for x, k in zip(data, _SEAT_TYPES))
            if not len(words):
                continue
            owner = np.repeat(np.arange(len(contexts)), wide)
            at, near = _found(order, words)
            kept = near & (_level(customers) >= least)
            chance = _chances(owner, len(contexts), once, customers, history.reshape(samples, -1), parents[:, at], how)[kept]
            before, usual = (x[owner[kept]] for x in _found(order, contexts))
            keys = _numbers(len(order), contexts[owner[kept]], before, usual, words[kept], at[kept], near[kept]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.log10(chance).astype(np.float32))], names=["pair", "chance"])

    got = model.seats.mapInArrow(run, "pair long, chance float").toArrow() if len(order) else None
    if not got:
        return np.empty(0, np.uint64), np.empty(0, np.float32)
    keys = got.column("pair").to_numpy().view(np.uint64)
    sorts = np.argsort(keys)
    return keys[sorts], got.column("chance").to_numpy()[sorts]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    how, samples, named, parts, owners = model.settings, len(model.roots), model.named, model.parts, model.owners
    found = model.pairs
    if docs is not model.docs:  # pairs of other documents are listed too
        found = materialize(pairs(docs, named, parts, found), "pairs")
    trained, scale = model.n, math.log10(model.n + 0.1 * (model.v + 1))
    chance_of, uniform = _root_chance(model), _root_chance(model)(np.zeros((samples, 2, 1)))[:, 0]
    near_pairs = _near_pairs(model)
    shared = docs.sparkSession.sparkContext.broadcast((model.order, model.parents, np.log10(model.often + 0.1) - scale, *near_pairs))

    def asked(batches):
        order = shared.value[0]
        for place, _, _, data in _parcels(batches):
            words = _stepped(data[4], int(_array(data[5], np.int64)[1]))
            words = words[~_found(order, words.view(np.int64))[1]]
            for part, low, high in _cut(words, owners):
                yield _parcel(part, ASKED, place, words[low:high])

    def answered(batches):
        place = None
        for part, kind, origin, data in _parcels(batches):
            if part != place:
                place, words = part, np.empty(0, np.uint64)
            if kind == WORDS:
                words, often = _array(data[0], np.uint64), _array(data[1], np.int64)
                chance = chance_of(_array(data[3], np.uint32).reshape(-1, 2, len(words))).astype(np.float32)
                continue
            at, known = _found(words, _array(data[0], np.uint64))
            if len(words):
                yield _parcel(origin, ANSWER, part, np.where(known, often[at], 0), np.where(known, chance[:, at], uniform[:, None].astype(np.float32)))
            else:
                yield _parcel(origin, ANSWER, part, np.zeros(len(at), np.int64), np.repeat(uniform[:, None].astype(np.float32), len(at), axis=1))

    def read(batches):
        order, _, plain, near, logs = shared.value
        number = TaskContext.get().partitionId() << 32
        for tokens, sizes, (ids, held, valid) in _chunks(batches):
            n, owner = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
            contexts = _contexts(tokens, sizes, named)
            at, usual = _found(order, tokens)
            follows = np.concatenate(([False], usual[:-1] & (contexts[1:] == tokens[:-1])))
            keys = _numbers(len(order), contexts, np.concatenate(([0], at[:-1])), follows, tokens, at, usual)
            sorts = np.argsort(keys)
            new = _firsts(keys[sorts])
            wide, firsts, owner = np.diff(np.append(new, len(keys))), sorts[new], owner[sorts]
            at, usual = at[firsts], usual[firsts]
            both = np.repeat(usual, wide)
            base = np.bincount(owner[both], np.repeat(plain[at[usual]], wide[usual]), n) if usual.any() else np.zeros(n)
            known = np.bincount(owner[both], minlength=n)
            at, settled = _found(near, keys[firsts])
            total = np.bincount(owner[np.repeat(settled, wide)], np.repeat(logs[at[settled]], wide[settled]), n) if settled.any() else np.zeros(n)
            yield _parcel(number, OWN, 0, ids, np.stack((held, valid)), sizes.astype(np.int64), base, known.astype(np.int64), total)
            rest = np.flatnonzero(~settled)
            part_of = _share_of(_scattered(contexts[firsts[rest]]), parts)
            by = np.argsort(part_of, kind="stable")
            rest, wide, own_keys = rest[by], wide[rest[by]], keys[firsts[rest[by]]]
            ends = np.cumsum(wide)
            owner = owner[np.repeat(new[rest] - ends + wide, wide) + np.arange(wide.sum())].astype(np.uint32)
            places, counts = _runs(part_of[by])
            for part, low, high in zip(places.tolist(), np.cumsum(counts) - counts, np.cumsum(counts)):
                own = owner[ends[low] - wide[low] : ends[high - 1]]
                yield _parcel(part, POSTED, number, _steps(own_keys[low:high]), _planes(wide[low:high].astype(np.uint32)), _planes(own), np.array([n, high - low, len(own)]))
            number += 1

    def looked_up(batches):
        place = listed = None
        for part, kind, origin, data in _parcels(batches):
            if kind == OWN:
                yield _parcel(part, OWN, 0, *(np.frombuffer(x.as_buffer(), np.uint8) for x in data))
                continue
            if part != place:
                place, listed, history, answers, chances = part, None, None, [], None
            if kind == PAIRS:
                listed = _pairs_of(data)
            elif kind == SEATS:
                history = _array(data[5], np.uint32)
            elif kind == ANSWER:
                answers.append((_array(data[0], np.int64), _array(data[1], np.float32).reshape(samples, -1)))
            else:
                if chances is None:
                    chances = table_of(listed, history, answers)
                keys, logs, plain, known = chances
                n, different, tokens = _array(data[3], np.int64).tolist()
                at, ok = _found(keys, _stepped(data[0], different))
                if not ok.all():
                    raise ValueError("a pair of a document is not in the model's list")
                at, owner = np.repeat(at, _unplaned(data[1], np.uint32, different)), _unplaned(data[2], np.uint32, tokens)
                yield _parcel(origin, SUMS, part, np.bincount(owner, plain[at], n), np.bincount(owner, known[at], n).astype(np.int64), np.bincount(owner, logs[at], n))

    def table_of(listed, history, answers):
        """Numbers of a part's pairs, sorted; their log10 probabilities; what they add to the base score and
        to the known tokens where the word is none of the near ones."""
        order, near_parents, *_ = shared.value
        own, lengths, places, customers, words = listed
        owner = np.repeat(np.arange(len(own)), lengths)
        at, near = _found(order, words)
        parents = near_parents[:, at].astype(np.float32) if len(order) else np.empty((samples, len(words)), np.float32)
        plain, known = np.zeros(len(words)), np.zeros(len(words), bool)
        if not near.all():
            # answers come in the order of the words' ranges, which is that of the words
            often, parents[:, ~near] = (np.concatenate(x, axis=-1) for x in zip(*answers))
            plain[~near], known[~near] = np.log10(often + 0.1) - scale, often > 0
        tables = _all_tables(customers, history, samples)
        logs = np.log10(_chances(owner, len(own), 0, customers, tables, parents[:, places], how))
        before, usual = (x[owner] for x in _found(order, own))
        keys = _numbers(len(order), own[owner], before, usual, words[places], at[places], near[places])
        plain, known = plain[places], known[places]
        sorts = np.argsort(keys)
        return keys[sorts], logs[sorts], plain[sorts], known[sorts]

    def finished(batches):
        place = held = None
        for part, kind, _, data in _parcels(batches):
            if part != place:
                if place is not None:
                    yield row_batch(*held)
                place = part
            if kind == OWN:
                kinds = (np.int64, bool, np.int64, float, np.int64, float)
                held = [_array(x, k).copy() for x, k in zip(data, kinds)]
            else:
                for i, kind_ in enumerate((float, np.int64, float)):
                    held[3 + i] += _array(data[i], kind_)
        if place is not None:
            yield row_batch(*held)

    def row_batch(ids, flags, sizes, base, known, total):
        out, valid = flags.reshape(2, -1)
        columns = [pa.array(ids, mask=~valid), pa.array(out), pa.array(sizes), pa.array(known), pa.array(np.full(len(ids), trained)), pa.array(base), pa.array(total)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = _read(docs).mapInArrow(read, PARCEL)
    answers = _met(owners, model.roots_by_word, found.mapInArrow(asked, PARCEL)).mapInArrow(answered, PARCEL)
    # the text is read once: the documents' own rows pass through the parts
    seats = model.seats.select(*(F.lit(None).cast("binary").alias(c) if c in "abcde" else c for c in PARCEL_NAMES))
    sums = _met(parts, found, seats, answers, rows).mapInArrow(looked_up, PARCEL)
    return _met(None, sums).mapInArrow(finished, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def stirling(discount: float, n: int = STIRLING) -> np.ndarray:
    """log S(c, t) for c, t <= n: the ways to seat c customers at t tables, weighted by their sizes."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(n + 1)
    for c in range(1, n + 1):
        stay = np.where(c - 1 - discount * t > 0, np.log(np.maximum(c - 1 - discount * t, 1e-300)), -np.inf) + out[c - 1]
        out[c, 1:] = np.logaddexp(out[c - 1, :-1], stay[1:])
    return out


def drawn(keys: np.ndarray, *salts: int) -> np.ndarray:
    """A number in (0, 1) for every key: the same however the rows are dealt to tasks."""
    h = keys.astype(np.int64).view(np.uint64)
    for salt in salts:
        h = mixed(h + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return ((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The quantile u of Binomial(n, p), for means up to some hundreds."""
    out = np.zeros(len(n), np.int64)
    odds = p / np.maximum(1 - p, 1e-300)
    mass = np.exp(n * np.log1p(-np.minimum(p, 1 - 1e-12)))
    below = mass.copy()
    left = np.flatnonzero((u > below) & (n > 0))
    while len(left):
        mass[left] *= (n[left] - out[left]) / (out[left] + 1) * odds[left]
        out[left] += 1
        below[left] += mass[left]
        left = left[(u[left] > below[left]) & (out[left] < n[left])]
    return np.where(p >= 1, n, out)


def seat(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, logs: np.ndarray, keys: np.ndarray, number: int) -> np.ndarray:
    """Tables of each word's customers. others: theta + discount * tables of the other words; parent:
    the word's probability in the parent restaurant; keys and number choose the random numbers."""
    chance = drawn(keys, number)
    tables = np.minimum(customers, 1)
    few = np.minimum(customers, STIRLING)
    # sorted by size, so that rows of like length share one matrix
    order = np.argsort(few, kind="stable")
    order = order[few[order] > 1]
    at = 0
    while at < len(order):
        c = int(few[order[at]])
        high = int(np.searchsorted(few[order], c + max(1, c // 8), side="left"))
        for low in range(at, high, max(1, 2_000_000 // (c + 1))):
            own = order[low : min(high, low + max(1, 2_000_000 // (c + 1)))]
            widest = int(few[own].max())
            t = np.arange(1, widest + 1)
            weight = np.cumsum(np.log(others[own, None] + discount * (t - 1)), axis=1)
            weight += t * np.log(parent[own, None]) + logs[few[own], 1 : widest + 1]
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            tables[own] = 1 + (weight < chance[own, None] * weight[:, -1:]).sum(axis=1)
        at = high
    many = np.flatnonzero(customers > STIRLING)
    seated, turn = np.full(len(many), STIRLING, np.int64), 0
    while len(many):
        fresh = (others[many] + discount * tables[many]) * parent[many]
        share = np.clip(fresh / (fresh + seated - discount * tables[many]), 0, 1)
        block = np.maximum(np.minimum(np.minimum(seated // 8, (30 / np.maximum(share, 1e-9)).astype(np.int64)), customers[many] - seated), 1)
        turn += 1
        tables[many] += binomial(block, share, drawn(keys[many], number, turn))
        seated += block
        left = seated < customers[many]
        many, seated = many[left], seated[left]
    return tables


def _shares(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each averaged sweep: mass that a context passes to its parent, 1 / its strength and customers,
    and (uniform mass, 1 / root strength and customers)."""
    how = model.settings
    passed = np.array([(how.strength + how.discount * t.tables) / (how.strength + t.customers) for t in model.averaged])
    weight = np.array([1 / (how.strength + t.customers) for t in model.averaged])
    root = np.array([[(how.root_strength + how.root_discount * t.root_tables) / (model.v + 1), 1 / (how.root_strength + t.root_customers)] for t in model.averaged])
    return passed, weight, root


def _predictive(batch: pa.RecordBatch, samples: int, shares, how: Settings):
    """Of rows with places, customers, tables, root_tables (null: unknown words): the parent's
    probability in each sample, and the places' own mass averaged over the samples."""
    passed, weight, root = shares
    places, wide = _flat(batch.column("places"), PLACE)
    customers, _ = _flat(batch.column("customers"), np.int64)
    history, _ = _flat(batch.column("tables"), np.int64)
    root_flat, known = _flat(batch.column("root_tables"), np.int64)
    root_tables = np.zeros((len(wide), samples))
    root_tables[known > 0] = root_flat.reshape(-1, samples)
    begin, owner = np.cumsum(wide) - wide, np.repeat(np.arange(len(wide)), wide)
    parent, own = np.empty((len(wide), samples)), np.zeros(len(places))
    for s in range(samples):
        tables = history[(begin * samples + wide * s)[owner] + np.arange(len(places)) - begin[owner]]
        seated = np.bincount(owner, tables, len(wide))
        parent[:, s] = (seated - how.root_discount * root_tables[:, s] + root[s, 0]) * root[s, 1]
        own += (customers - how.discount * tables) * weight[s, places] / samples
    return parent, own, places, owner


def perplexity(scores: DataFrame) -> float:
    """10 to the mean negative log10 probability of a token, over the rows of score(); null without rows."""
    total = scores.agg(F.sum("score"), F.sum("n_tokens")).first()
    return None if not total[1] else 10 ** (-total[0] / total[1])


def op9_pitman_yor(spark, sf_dir) -> DataFrame:
    """Scores of all documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, train(docs))
