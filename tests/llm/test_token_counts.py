import random

import numpy as np
import pytest

from freshet.llm import bpe
from freshet.llm.token_counts import count_tokens, read_files, write_stream


def plain(ids, end):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((start, i - start, True))
            start = i + 1
    return out + ([(start, len(ids) - start, False)] if start < len(ids) else [])


@pytest.mark.parametrize("width", [2, 4])
def test_files_of_all_shapes(spark, tmp_path, width):
    draw = random.Random(width)
    files = {}
    for i in range(12):
        ids = [9 if draw.random() < draw.choice([0.02, 0.5]) else draw.randrange(8) for _ in range(draw.randrange(1, 200))]
        files[f"f{i}.bin"] = ids
    files |= {"none.bin": [1] * 70, "ends.bin": [9] * 20, "exact.bin": [1] * 15 + [9], "empty.bin": []}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, f"<u{width}").tobytes())
    rows = count_tokens(read_files(spark, str(tmp_path), width, 16), 9, width, 16).collect()
    for name, ids in files.items():
        got = sorted((r.doc, r.start, r.n_tokens, r.closed) for r in rows if r.file.endswith("/" + name))
        assert got == [(i, *x) for i, x in enumerate(plain(ids, 9))]


def test_documents_in_order(documents, odd_docs, no_docs):
    for docs in (documents, odd_docs):
        docs = docs.coalesce(1)
        expected = [r.n_tokens for r in bpe.encode(docs).collect()]
        rows = count_tokens(write_stream(docs, block_tokens=1000), block_tokens=1000).orderBy("doc").collect()
        assert [r.doc_id for r in rows] == [r.doc_id for r in docs.collect()]
        assert [r.n_tokens for r in rows] == expected and all(r.closed for r in rows)
    assert count_tokens(write_stream(no_docs)).count() == 0


def test_runs_of_blocks(spark, monkeypatch):
    """Documents over many blocks and runs of blocks, and block borders at separators."""
    from freshet.llm import token_counts

    monkeypatch.setattr(token_counts, "RUN", 3)
    draw = random.Random(4)
    files = {f"f{i}": [9 if draw.random() < p else 1 for _ in range(n)] for i, (n, p) in enumerate([(200, 0.3), (333, 0.01), (64, 0.0), (65, 1.0), (1, 0.0), (128, 0.02)])}
    rows = [(f, b, np.array(ids[8 * b : 8 * b + 8], "<u2").tobytes()) for f, ids in files.items() for b in range(-(-len(ids) // 8))]
    draw.shuffle(rows)
    got = count_tokens(spark.createDataFrame(rows, "file string, block long, tokens binary"), 9, 2, 8).collect()
    for f, ids in files.items():
        assert sorted((r.doc, r.start, r.n_tokens, r.closed) for r in got if r.file == f) == [(i, *x) for i, x in enumerate(plain(ids, 9))]


def test_ids_that_do_not_fit(documents):
    with pytest.raises(Exception, match="does not fit"):
        write_stream(documents, width=1, separator=255).count()
    with pytest.raises(ValueError):
        write_stream(documents, separator=70_000)


def test_the_query(spark, documents):
    from freshet.llm.token_counts import op7_separator_scan

    expected = {r.doc_id: r.n_tokens for r in bpe.encode(documents).collect()}
    rows = op7_separator_scan(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.n_tokens for r in rows} == expected and len(rows) == len(expected) and all(r.closed for r in rows)
