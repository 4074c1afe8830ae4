import math

import numpy as np

from freshet.llm import topk


def brute(rows, k):
    fine = [(i, [math.floor(64 * float(c)) for c in x]) for i, x in rows if i is not None and x and all(c is not None and math.isfinite(c) for c in x)]
    out = {}
    for q, x in fine:
        if q % 20 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in fine if i != q and len(x) == len(y)))[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


def as_dict(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 8)
    draw = np.random.default_rng(0)
    centres = draw.normal(size=(6, 8))
    x = (centres[draw.integers(0, 6, 700)] + 0.2 * draw.normal(size=(700, 8))).astype(np.float32)
    x[5] = x[6] = x[100]  # ties
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1020, [float("nan")] * 8, 1), (1040, [None] * 8, 1), (None, [1.0] * 8, 1), (1060, [], 1), (1061, [float("inf")] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    for block in (16384, 10):
        got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=7, query_block=block, candidate_block=block * 9).collect()
        assert as_dict(got) == brute([(r[0], r[1]) for r in rows], 7)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert as_dict(topk.top_k(df, df.where("vec_id % 20 = 0")).collect()) == {0: [(1, 64 * 32 + 128 * 32)]}
    none = df.where("vec_id > 5")
    assert topk.top_k(none, none).count() == 0


def test_nodes_are_pruned():
    draw = np.random.default_rng(1)
    centres = 10 * draw.normal(size=(40, 6))
    points = np.floor(64 * (centres[draw.integers(0, 40, 8000)] + 0.05 * draw.normal(size=(8000, 6))))
    tree = topk.CoverTree(points)
    asked = topk.CoverTree(points[:400])
    ids = np.arange(8000)
    best = topk.Best(400, 20)
    scored = topk.search(asked, ids[:400], tree, ids, best)
    assert scored < 0.5 * 400 * 8000
    full = points[:400] @ points.T
    full[np.arange(400), np.arange(400)] = -np.inf
    assert (np.sort(best.scores, axis=1) == np.sort(np.sort(full, axis=1)[asked.rows][:, -20:], axis=1)).all()


def test_repeated_ids_in_several_blocks(spark):
    """Every different vector of a repeated id gets its own answer, however the queries are dealt."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(40, 4))
    rows = [(20, v.tolist()) for v in x] + [(100 + i, v.tolist()) for i, v in enumerate(draw.normal(size=(60, 4))) if (100 + i) % 20]
    rows += [(20, x[0].tolist()), (101, rows[41][1])]  # repeated rows: asked once, candidates each
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fine = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows]
    expected = []
    for q in {tuple(v) for i, v in fine if i == 20}:
        best = sorted((-int(np.dot(q, v)), i) for i, v in fine if i != 20)[:5]
        expected += [(rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    for block in (1000, 4):
        got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=5, query_block=block, candidate_block=7 * block).collect()
        assert len(got) == 200 and all(r.query_id == 20 for r in got)
        assert sorted((r.rank, r.vec_id, r.score) for r in got) == sorted(expected)


def test_the_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    got = topk.op4_dual_tree(spark, "/root/testdata/sf0.001").collect()
    assert as_dict(got) == brute([(r[0], r[1]) for r in rows], 20)
