"""Near-duplicate groups by a chosen-path set similarity join on word shingles.

1. Sketch. One pass over the texts hashes every document's distinct shingles and keeps their count, a
   128-bit digest of the set, and `coords` minwise hashes. Equal sets are one class from here on, so
   a group of exact copies, however large, is one row.
2. Branch. Each of `trees` trees sends a class down `branch` paths: the path's node is named by a
   chosen minwise coordinate and the class's token there. A node of more than `node_limit` classes
   branches again on coordinates chosen by a hash of the node; smaller ones, and after `depth` levels
   the dense nodes that stay large, are compared exhaustively by their minwise hashes (large nodes in
   pairs of blocks, so no task holds more than two blocks). A tree has coordinates of its own, and
   each of its levels has some of them, so trees are independent and no path meets a coordinate
   twice. A pair at similarity s is missed by one tree with the probability q of the fixed point
   q = (1 - s * (1 - q)) ** branch at worst: for s = 0.85 and 2 branches 0.031, and so about 1e-6
   with 4 trees (were the branches of one level independent; they share that level's coordinates).
3. Confirm. Candidates (estimates no more than five standard deviations below the threshold) are
   gathered in connected clusters; every pair of classes of a cluster is compared on the full sets,
   again in pairs of blocks where a cluster is large. Confirmed links give the components.

Links are never expanded into all pairs: tasks emit spanning forests.

Words are runs of `[^\\x20\\x09-\\x0D]` after lower-casing A-Z. A text of fewer than `width` words is
one shingle, its whole sequence.

Cases: a null or empty text, or one without words, has no shingles and links with nothing; a document
without an id has a null component and is kept; rows that repeat an id and a text are both in the
id's component; rows that repeat an id with other texts are documents of their own, linked by their
texts alone; an empty table gives an empty result; extra columns are not read. one_of_each() goes by
rows: of any rows in one group, repeated ids and rows without an id among them, one stays.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import materialize, table
from freshet.llm.graph import components
from freshet.llm.text import hashed_words, mixed

#: Elements of a block of minwise products.
BLOCK = 8192
#: A block of a large cluster holds about so many sets and bytes of sets.
BLOCK_SETS, BLOCK_BYTES = 512, 24 << 20
#: Rows (of 24 bytes) up to which the ids of candidates are broadcast; above, they are joined by a shuffle.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Join:
    """Shingle width; a link has den * |A & B| >= num * |A | B|; the rest bounds work and recall."""

    width: int = 5
    num: int = 80
    den: int = 100
    trees: int = 4
    branch: int = 2
    coords: int = 64
    node_limit: int = 1024
    depth: int = 3

    def __post_init__(self):
        if self.coords // self.trees < self.branch * (self.depth + 1):
            raise ValueError("a tree needs `branch` coordinates for each of its levels")

    def level(self, tree: int, level: int) -> tuple[int, int]:
        """The first coordinate of a tree's level, and how many it has."""
        own = self.coords // self.trees
        first, last = own * level // (self.depth + 1), own * (level + 1) // (self.depth + 1)
        return tree * own + first, last - first

    @property
    def least_equal(self) -> int:
        """Equal coordinates, of coords, that make a candidate."""
        s = self.num / self.den
        return max(1, math.floor(self.coords * (s - 5 * math.sqrt(s * (1 - s) / self.coords))))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text's word hashes."""
    if not len(hashes):
        return hashes
    span = min(width, len(hashes))
    out = np.full(len(hashes) - span + 1, span, np.uint64)
    for i in range(span):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - span + 1 + i])
    return np.unique(out)


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The shingles of every text of a column."""
    for hashes, counts in hashed_words(column):
        for stop, n in zip(np.cumsum(counts).tolist(), counts.tolist()):
            yield shingles(hashes[stop - n : stop], width)


def minwise(found: np.ndarray, coords: int) -> bytes:
    """The top 32 bits of coords minwise hashes of a set."""
    draw = np.random.default_rng(20_240_607)
    a = draw.integers(1, 2**63, coords, np.uint64) * np.uint64(2) + np.uint64(1)
    b = draw.integers(0, 2**63, coords, np.uint64)
    low = np.full(coords, np.iinfo(np.uint64).max)
    for at in range(0, len(found), BLOCK):
        low = np.minimum(low, (a[:, None] * found[None, at : at + BLOCK] + b[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype("<u4").tobytes()


def sketch(docs: DataFrame, how: Join, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_id (null without shingles), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, sigs = [], [], []
            for found in _sets(batch.column(1), how.width):
                sizes.append(len(found))
                ids.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sigs.append(minwise(found, how.coords) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "set_id", "sig"],
            )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_id binary, sig binary")


def _token(at: Column) -> Column:
    return F.substring(F.col("sig"), at * 4 + 1, F.lit(4))


def _blocks(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """Every row once for each pair of blocks that its block is in: columns lo, hi, own (its block).
    A group of one block has one pair, (0, 0)."""
    own = F.pmod(F.xxhash64("rep"), F.col("_n")).cast("int")
    rows = rows.withColumn("_n", blocks.cast("int")).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.select("*", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).drop("_n", "other")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Runs of equal (group, lo, hi) in sorted batches (group, lo, hi, own, rep, value): whole runs,
    as many as a batch ends, with their start offsets."""
    held: list[tuple] = []
    for batch in batches:
        rows = [*held, *zip(*(c.to_pylist() for c in batch.columns))]
        last = rows[-1][:3] if rows else None
        cut = len(rows)
        while cut and rows[cut - 1][:3] == last:
            cut -= 1
        if cut:
            yield _starts(rows[:cut])
        held = rows[cut:]
    if held:
        yield _starts(held)


def _starts(rows: list[tuple]) -> tuple[list[tuple], list[int]]:
    return rows, [i for i in range(len(rows)) if not i or rows[i][:3] != rows[i - 1][:3]] + [len(rows)]


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def joined(self, x: int, y: int) -> bool:
        """Join two trees; False if they were one."""
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _similar(how: Join):
    """Edges of spanning forests of the classes of a node whose minwise hashes agree often enough."""

    def run(batches):
        for rows, starts in _groups(batches):
            sigs = np.frombuffer(b"".join(r[5] for r in rows), "<u4").reshape(len(rows), how.coords)
            node = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            wide = np.diff(starts)
            out = []
            # short runs all at once: each row against the one d further on
            short = (wide <= 16)[node]
            for d in range(1, min(16, len(rows))):
                at = np.flatnonzero(short[:-d] & (node[:-d] == node[d:]))
                if not len(at):
                    break
                for step in range(0, len(at), 1 << 16):
                    i = at[step : step + (1 << 16)]
                    hit = i[(sigs[i] == sigs[i + d]).sum(axis=1) >= how.least_equal]
                    out += [(rows[x][4], rows[x + d][4]) for x in hit.tolist() if rows[x][1] == rows[x][2] or rows[x][3] != rows[x + d][3]]
            for k in np.flatnonzero(wide > 16).tolist():
                first, last = starts[k], starts[k + 1]
                own = sigs[first:last]
                agree = ((np.flatnonzero((own[i + 1 :] == own[i]).sum(axis=1) >= how.least_equal) + i + 1) for i in range(last - first - 1))
                out += [(rows[first + i][4], rows[first + j][4]) for i, j in _spanning(rows[first:last], agree)]
            if out:
                yield _edges(out)

    return run


def _spanning(rows: list[tuple], found: Iterator[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Edges (i, j) of a spanning forest of a run of rows (group, lo, hi, own, ...); found: for each row the later
    ones that it meets. Where the run is two blocks, the edges inside a block come from that block's
    own run and only those between the blocks are given: few, where the blocks are dense."""
    block, apart = np.array([r[3] for r in rows]), rows[0][1] != rows[0][2]
    forest, between = _Forest(len(rows)), []
    for i, later in enumerate(found):
        inside = block[later] == block[i]
        for j in later[inside].tolist():
            if forest.joined(i, j) and not apart:
                yield i, j
        if not inside.all():
            between.append((i, later[~inside]))
    for i, later in between:
        for j in later.tolist():
            if forest.joined(i, j):
                yield i, j


def _confirmed(how: Join):
    """Edges of spanning forests of the links of a cluster, from the full sets."""

    def run(batches):
        for rows, starts in _groups(batches):
            out = []
            for first, last in zip(starts, starts[1:]):
                group = rows[first:last]
                sets = [np.frombuffer(r[5], np.uint64) for r in group]
                out += [(group[i][4], group[j][4]) for i, j in _spanning(group, _links(sets, how))]
            if out:
                yield _edges(out)

    return run


def _links(sets: list[np.ndarray], how: Join) -> Iterator[np.ndarray]:
    """For each set the later ones that it links with."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        yield np.ones(1, np.int64) if shared * (how.den + how.num) >= how.num * int(sizes.sum()) else np.empty(0, np.int64)
        return
    values = np.concatenate(sets) if n else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    _, begin, often = np.unique(values[order], return_index=True, return_counts=True)
    run_of = np.empty(len(values), np.int64)
    run_of[order] = np.repeat(np.arange(len(begin)), often)
    posting = owner[order]
    at = 0
    for i in range(n):
        runs = run_of[at : at + sizes[i]]
        at += sizes[i]
        runs = runs[often[runs] > 1]
        if not len(runs):
            yield np.empty(0, np.int64)
            continue
        lengths = often[runs]
        place = np.repeat(begin[runs] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        shared = np.bincount(posting[place], minlength=n)
        linked = shared * (how.den + how.num) >= how.num * (sizes + sizes[i])
        yield np.flatnonzero(linked[i + 1 :]) + i + 1


def _bounded(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if their number allows it."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _compared(rows: DataFrame, how: Join) -> DataFrame:
    dealt = rows.select("node", "lo", "hi", "own", "rep", "sig").repartition("node", "lo", "hi")
    return dealt.sortWithinPartitions("node", "lo", "hi", "rep").mapInArrow(_similar(how), "a long, b long")


def candidates(classes: DataFrame, how: Join) -> DataFrame:
    """(node, component): the classes (rep, sig) in groups connected by pairs that meet in a node and look
    similar. The first tree goes alone. A later tree need not look at nodes whose classes one group of
    the first tree holds already: confirmation compares all of a group anyway, so a dense group is
    listed in one tree, not in all."""
    known = components(_met(classes.select("rep", "sig", F.col("rep").alias("group")), how, range(1)))
    if how.trees == 1:
        return known
    grouped = classes.join(known, F.col("rep") == F.col("node"), "left").select("rep", "sig", F.coalesce("component", "rep").alias("group"))
    more = _met(materialize(grouped, "grouped"), how, range(1, how.trees))
    return components(more.union(known.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def _met(classes: DataFrame, how: Join, trees: range) -> DataFrame:
    """Edges (a, b) between classes (rep, sig, group) of some trees, of the nodes that hold more than one group.
    Only large nodes are listed apart: each has over node_limit classes, so there are few of them."""

    def paths(tree: Column, level: int, node: Column) -> Column:
        """The nodes below node (a number): `branch` different coordinates of the tree's level, from a
        place that the node's hash chooses."""
        first, n = how.level(0, level)
        at = [F.pmod(F.xxhash64(node, F.lit(level)) + s, F.lit(n)) + first + tree * (how.coords // how.trees) for s in range(how.branch)]
        return F.array(*(F.xxhash64(node, x, _token(x.cast("int"))) for x in at))

    roots = F.flatten(F.array(*(F.transform(paths(F.lit(t), 0, F.lit(t)), lambda x, t=t: F.struct(F.lit(t).alias("tree"), x.alias("node"))) for t in trees)))
    rows = classes.select("rep", "sig", "group", F.explode(roots).alias("path")).select("rep", "sig", "group", "path.*")
    edges = None
    for level in range(how.depth + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("count"), (F.min("group") == F.max("group")).alias("settled"))
        large = materialize(sizes.where(F.col("count") > how.node_limit), "large")
        side = _bounded(large)
        whole = rows.join(side, "node", "left_anti").select("*", *(F.lit(0).alias(c) for c in ("lo", "hi", "own")))
        found = _compared(whole, how)
        edges = found if edges is None else edges.union(found)
        if large.isEmpty():
            break
        rows = rows.join(side.where("not settled").drop("settled"), "node")
        if level == how.depth:
            edges = edges.union(_compared(_blocks(rows, "node", F.ceil(F.col("count") / how.node_limit)), how))
            break
        rows = materialize(rows.select("rep", "sig", "group", "tree", F.explode(paths(F.col("tree"), level + 1, F.col("node"))).alias("node")), "nodes")
    return edges


def confirmed(docs: DataFrame, clusters: DataFrame, how: Join) -> DataFrame:
    """Edges (a, b) of the links inside each cluster. docs: doc_id and text; clusters: node (the key of
    a class), component, n_shingles, rep (a doc_id that has its set), set_id."""
    total = clusters.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("size"))
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("size") * 8 / BLOCK_BYTES))
    chosen = clusters.join(total, "component").select("component", "node", "rep", blocks.cast("int").alias("blocks"), "set_id")
    chosen = materialize(chosen, "chosen")
    texts = docs.join(_bounded(chosen), F.col("doc_id") == F.col("rep")).select("component", "node", "blocks", "set_id", "text")

    def run(batches):
        for batch in batches:
            sets, keep = [], []
            for i, (found, digest) in enumerate(zip(_sets(batch.column(4), how.width), batch.column(3).to_pylist())):
                found = found.tobytes()
                # another row may carry the same id with another text
                if hashlib.blake2b(found, digest_size=16).digest() == digest:
                    sets.append(found)
                    keep.append(i)
            for at in range(0, len(keep), 256):
                part = batch.take(pa.array(keep[at : at + 256], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(sets[at : at + 256], pa.binary())],
                    names=["component", "rep", "blocks", "value"],
                )

    sets = texts.mapInArrow(run, "component long, rep long, blocks int, value binary")
    dealt = _blocks(sets, "component", F.col("blocks")).select("component", "lo", "hi", "own", "rep", "value")
    dealt = dealt.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "rep")
    return dealt.mapInArrow(_confirmed(how), "a long, b long")


def near_duplicates(docs: DataFrame, how: Join = Join(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links,
    its own included), kept (it is that smallest one, or has no id)."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = materialize(sketch(docs, how), "sketch")
    known = rows.where("doc_id is not null and set_id is not null")
    classes = known.groupBy("set_id").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")
    )
    classes = materialize(classes.withColumn("node", F.xxhash64("set_id")), "classes")
    near = candidates(classes.select(F.col("node").alias("rep"), "sig"), how)
    near = near.join(classes.select("node", "rep", "set_id", "n_shingles"), "node")
    linked = components(confirmed(docs, near, how)).join(classes.select("node", "rep"), "node")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "component").select("node", "least")
    found = classes.select("node", "set_id", "rep", "copies").join(linked, "node", "left")
    found = found.where("copies > 1 or least is not null").select("set_id", F.coalesce("least", "rep").alias("least"))
    out = rows.select("doc_id", "n_shingles", "set_id").join(found, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select(
        F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def one_of_each(docs: DataFrame, how: Join = Join(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates: the smallest id's, rows without an id after
    all others. Rows are numbered, so that repeated ids and missing ones are told apart."""
    row = "row"
    while row in docs.columns:
        row = "_" + row
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    near = near_duplicates(rows, how, row, text).where("component_id is not null").select(F.col(row).alias("_number"), "component_id")
    near = materialize(near, "near")
    groups = near.where(F.col("_number") != F.col("component_id")).select("component_id").distinct()
    members = near.join(groups, "component_id").join(rows.select(F.col(row).alias("_number"), F.col(key).cast("long").alias("_id")), "_number")
    first = members.groupBy("component_id").agg(F.min_by("_number", F.struct(F.col("_id").isNull(), "_id", "_number")).alias("_first"))
    gone = materialize(members.join(first, "component_id").where("_number <> _first").select(F.col("_number").alias("_gone")), "gone")
    return rows.join(_bounded(gone), F.col(row) == F.col("_gone"), "left_anti").drop(row)


def op3_chosen_path(spark, sf_dir) -> DataFrame:
    """Components of all documents: three-word shingles, similarity 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), Join(width=3, num=85, den=100))
