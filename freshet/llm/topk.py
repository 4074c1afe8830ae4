"""Exact top-k inner-product search by a dual-tree traversal over cover trees.

Queries and candidates are dealt into blocks of a bounded size, and a task meets one block of each; no
vector reaches the driver. Both blocks are indexed by cover trees. A node's children are chosen by farthest-first
traversal from the node's own centre, so they are at least their scale apart and cover the node's
points within it (separation, covering, nesting), and every node keeps the true radius of its points.
For a pair of nodes, <q, c> <= <Q, C> + |Q| r_C + |C| r_Q + r_Q r_C bounds every score; the pair is
pruned when the bound is below the worst kth score among the query node's queries, and pairs of leaves
are scored exactly. The most promising pairs are visited first. A task reports each query's k best, and
a last step ranks them over all blocks; ties go to the smaller id.

Components are turned into floor(scale * x); scores are exact integers while their absolute sum stays
below 2**53.

Cases: rows whose vector is null, empty or holds a null or non-finite component take no part, nor do
rows without an id or with another number of components than the query; rows that repeat an id are
candidates each on its own, none for the queries of that id, which are asked once for each different
vector; fewer than k candidates are all returned; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import materialize, table

#: Points of a leaf, children of a node, candidates of one tree.
LEAF, FANOUT, TREE = 96, 12, 16_384


class Node:
    __slots__ = ("centre", "children", "first", "last", "norm", "radius")


class CoverTree:
    """points are reordered so that every node's are contiguous; rows[i] is the place point i had."""

    def __init__(self, points: np.ndarray):
        self.rows = np.arange(len(points))
        self.points = points
        self.root = self._node(0, len(points), 0)
        self.points = points[self.rows]

    def _node(self, first: int, last: int, centre: int) -> Node:
        """centre: place among the node's rows of its centre, which becomes the first."""
        node = Node()
        rows = self.rows[first:last]
        rows[[0, centre]] = rows[[centre, 0]]
        own = self.points[rows]
        node.centre, node.norm = own[0], float(np.sqrt((own[0] ** 2).sum()))
        node.first, node.last, node.children = first, last, []
        far = ((own - own[0]) ** 2).sum(axis=1)
        node.radius = float(np.sqrt(far.max())) * (1 + 1e-12)
        if last - first <= LEAF or node.radius == 0:
            return node
        centres, nearest = [0], np.zeros(len(rows), np.int64)
        while len(centres) < FANOUT and far.max() > 0:
            at = int(far.argmax())
            away = ((own - own[at]) ** 2).sum(axis=1)
            closer = away < far
            nearest[closer] = len(centres)
            far = np.minimum(far, away)
            centres.append(at)
        order = np.argsort(nearest, kind="stable")
        self.rows[first:last] = rows[order]
        ends = np.cumsum(np.bincount(nearest, minlength=len(centres)))
        for k, (low, high) in enumerate(zip([0, *ends[:-1]], ends)):
            child = int(np.flatnonzero(order[low:high] == centres[k])[0])
            node.children.append(self._node(first + int(low), first + int(high), child))
        return node


class Best:
    """The k best scores of every query so far, ties by the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, first: int, last: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores of the queries first to last for candidates ids; -inf: no candidate."""
        use = np.flatnonzero((scores >= self.scores[first:last, -1:]).any(axis=1) if self.k else [])
        for q in use.tolist():
            hit = np.flatnonzero((scores[q] >= self.scores[first + q, -1]) & np.isfinite(scores[q]))
            if not len(hit):
                continue
            all_scores = np.concatenate((self.scores[first + q], scores[q, hit]))
            all_ids = np.concatenate((self.ids[first + q], ids[hit]))
            keep = np.lexsort((all_ids, -all_scores))[: self.k]
            self.scores[first + q], self.ids[first + q] = all_scores[keep], all_ids[keep]

    def worst(self, first: int, last: int) -> float:
        return float(self.scores[first:last, -1].min())


def search(queries: CoverTree, query_ids: np.ndarray, candidates: CoverTree, candidate_ids: np.ndarray, best: Best) -> int:
    """Adds the candidates' scores to best (by the queries' places in their tree); returns how many
    pairs were scored."""
    names, asks = candidate_ids[candidates.rows], query_ids[queries.rows]
    scored = 0

    def bound(a: Node, b: Node) -> float:
        top = float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        return top + 1e-9 * (a.norm + a.radius) * (b.norm + b.radius) + 1e-6  # never below the true bound

    order = 0
    heap = [(-bound(queries.root, candidates.root), 0, queries.root, candidates.root)]
    while heap:
        high, _, a, b = heapq.heappop(heap)
        if -high < best.worst(a.first, a.last):
            continue
        if not a.children and not b.children:
            scores = queries.points[a.first : a.last] @ candidates.points[b.first : b.last].T
            scored += scores.size
            ids = names[b.first : b.last]
            scores[asks[a.first : a.last, None] == ids[None, :]] = -np.inf
            best.add(a.first, a.last, scores, ids)
            continue
        if b.children and (not a.children or b.radius >= a.radius):
            pairs = [(a, x) for x in b.children]
        else:
            pairs = [(x, b) for x in a.children]
        for x, y in pairs:
            top = bound(x, y)
            if top >= best.worst(x.first, x.last):
                order += 1
                heapq.heappush(heap, (-top, order, x, y))
    return scored


def _whole(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(F.col(key).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & fine & (F.size("x") > 0))
    return rows.select("id", F.transform("x", lambda v: F.floor(v * scale).cast("double")).alias("x"))


def _matrix(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by their number of components: their places, and a matrix."""
    lengths = np.asarray(pc.list_value_length(column))
    flat, begin = pc.list_flatten(column).to_numpy(), np.cumsum(lengths) - lengths
    out = {}
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        out[n] = at, flat[begin[at, None] + np.arange(n)]
    return out


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, query_block: int = 32_768, candidate_block: int = 65_536, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates but itself. A task holds
    about query_block queries and candidate_block candidates, less where there are too few blocks for
    all cores; every candidate is sent once for each block of queries and the other way round."""
    cores = candidates.sparkSession.sparkContext.defaultParallelism
    asked = _whole(queries, key, vector, scale).distinct().withColumn("place", F.monotonically_increasing_id())
    asked = materialize(asked, "queries")  # place tells apart the vectors of a query id that has several
    rows = _whole(candidates, key, vector, scale)
    blocks = max(1, -(-asked.count() // query_block))
    n = candidates.count()
    cells = max(1, -(-n // candidate_block), min(-(-n // 4096), 2 * cores // blocks))
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cells)).cast("int")
    rows = rows.select("id", "x", number.alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = asked.select(
        "id", "x", "place", F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"),
    )
    met = asked.groupBy("block", "cell").cogroup(rows.groupBy("block", "cell"))
    found = met.applyInArrow(_searcher(k), "query long, vec long, score long, place long")
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "vec"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("vec").alias(key), "score")


def _searcher(k: int):
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        ids, places = asked.column("id").to_numpy(), asked.column("place").to_numpy()
        names = rows.column("id").to_numpy()
        near = _matrix(rows.column("x")) if rows.num_rows else {}
        out = [[np.empty(0, np.int64)] * 4]
        for n, (at, x) in (_matrix(asked.column("x")) if asked.num_rows else {}).items():
            if n not in near:
                continue
            tree, best = CoverTree(x), Best(len(at), k)
            own, points = near[n]
            for low in range(0, len(own), TREE):
                search(tree, ids[at], CoverTree(points[low : low + TREE]), names[own[low : low + TREE]], best)
            q, j = np.nonzero(np.isfinite(best.scores))
            place = at[tree.rows[q]]
            out.append([ids[place], best.ids[q, j], best.scores[q, j].astype(np.int64), places[place]])
        return pa.table([np.concatenate(c) for c in zip(*out)], names=["query", "vec", "score", "place"])

    return run


def op4_dual_tree(spark, sf_dir) -> DataFrame:
    """The 20 best of all vectors for every 20th."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % 20 == 0))


#: The same by brute force.
OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT DISTINCT vec_id, x FROM v WHERE vec_id % 20 = 0), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM q, v WHERE q.vec_id <> v.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

