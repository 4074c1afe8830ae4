import zlib

from freshet.llm.sharding import shard_by_bytes


def expected(rows, shards=8):
    rows = sorted(rows, key=lambda r: (zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()), r[0] is not None, r[0] or 0))
    total, start, slots, out = sum(len((t or "").encode()) + 1 for _, t in rows), 0, {}, []
    for key, text in rows:
        size = len((text or "").encode()) + 1
        shard = (2 * start + size) * shards // (2 * total)
        out.append((key, size, zlib.crc32((text or "").encode()), shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        start += size
    return out


def test_against_plain_prefix_sums(documents, odd_docs):
    for docs in (documents, odd_docs):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in shard_by_bytes(docs).collect()]
        assert sorted(got, key=str) == sorted(expected(rows), key=str)


def test_empty(no_docs):
    assert shard_by_bytes(no_docs).count() == 0


def test_equal_texts_stay_together(spark):
    rows = [(i, f"text {i % 40} " + "x" * (i % 40)) for i in range(4000)] + [(None, ""), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = shard_by_bytes(docs, 8).collect()
    shards = {}
    for r in placed:
        shards.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert len(shards) == 41 and sum(len(x) - 1 for x in shards.values()) <= 7


def test_the_query(spark, documents):
    import zlib

    from freshet.llm.sharding import op2_prefix_shards

    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    rows = op2_prefix_shards(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len(t) + 1, zlib.crc32(t)) for d, t in texts.items()}
    for shard in range(8):
        own = [r for r in rows if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - sum(r.size for r in rows) / 8) <= max(r.size for r in rows)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
