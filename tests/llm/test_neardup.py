import random
import re

import pytest

from freshet.llm import neardup
from freshet.llm.graph import components
from freshet.llm.neardup import Join, near_duplicates


def brute(rows, width, num, den):
    """{doc_id: (set size, smallest id reachable)} by comparing all pairs."""
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        grams = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)] or ([tuple(words)] if words else [])
        sets[doc_id] = set(grams)
    least = {d: d for d in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and num * max(len(x), len(y)) <= den * min(len(x), len(y)) and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                least[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


def check(docs, how):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, how).collect()}
    assert got == brute(rows, how.width, how.num, how.den)


def family(draw, n, edits, size=60):
    base = [f"w{draw.randrange(500)}" for _ in range(size)]
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randrange(edits + 1)):
            words[draw.randrange(size)] = f"x{draw.randrange(10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("how", [Join(), Join(3, 85, 100, node_limit=8, depth=1), Join(3, 85, 100, node_limit=6)])
def test_families_against_all_pairs(spark, how, monkeypatch):
    draw = random.Random(how.node_limit)
    texts = [t for _ in range(12) for t in family(draw, 25, 6)] + list(family(draw, 90, 12)) + ["a b", "A  B", "a", "", None, "x y z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(neardup, "BLOCK_SETS", 16)
    check(docs, how)


def test_documents(documents):
    check(documents, Join(3, 85, 100))
    check(documents, Join(3, 85, 100, node_limit=2))  # where nearly every node branches


def test_repeated_ids_with_other_texts(spark):
    draw = random.Random(2)
    one, two = (" ".join(f"w{draw.randrange(900)}" for _ in range(60)) for _ in range(2))
    rows = [(5, one), (5, two), (7, one + " x"), (8, two + " x"), (9, one), (9, one), (None, one), (None, two)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row long")
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(docs).collect() if r.doc_id is not None)
    assert got == [(5, 5), (5, 5), (7, 5), (8, 5), (9, 5), (9, 5)]
    left = neardup.one_of_each(docs).collect()
    assert sorted(r.row for r in left) == [0, 1]
    only = docs.where("doc_id is null or doc_id = 5 and row = 1")
    assert sorted(r.row for r in neardup.one_of_each(only).collect()) == [1, 6]
    apart = docs.where("row in (1, 2)")  # the id 5 has another text elsewhere: no link through the id
    assert {r.component_id for r in near_duplicates(apart).collect()} == {5, 7}


def test_the_query(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = neardup.op3_chosen_path(spark, "/root/testdata/sf0.001").collect()
    expected = brute(rows, 3, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = near_duplicates(odd_docs, Join(3, 85, 100)).collect()
    assert len(rows) == 8
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert {r.component_id for r in rows if r.doc_id == 1} == {1}
    assert all(r.n_shingles == 0 and r.kept for r in rows if r.doc_id in (2, 3))
    assert near_duplicates(no_docs).count() == 0


def test_components(spark):
    draw = random.Random(9)
    for n, m in ((200, 150), (40, 39)):
        edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] if m < n - 1 else [(i, i + 1) for i in range(m)]
        least = list(range(n))
        for _ in range(n):
            for a, b in edges:
                least[a] = least[b] = min(least[a], least[b])
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: least[x] for e in edges for x in e if any(a != b and x in (a, b) for a, b in edges)}
