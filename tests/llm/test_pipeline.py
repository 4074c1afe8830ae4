import corpus_pipeline
from freshet.llm import neardup, quality, secrets
from test_neardup import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = documents
    verdicts = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    good = corpus_pipeline.quality_rules(spark, docs, SF)
    assert good.columns == documents.columns
    assert sorted(r.doc_id for r in good.select("doc_id").collect()) == sorted(d for d, k in verdicts.items() if k)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    single = corpus_pipeline.near_duplicates(spark, good, SF)
    least = brute(rows, 5, 80, 100)
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, (_, x) in least.items() if x == d)
    masked = corpus_pipeline.secret_scan(spark, single, SF)
    assert masked.columns == documents.columns
    model = secrets.default_model(single)
    before = {r.doc_id: (r.text, [*r.base, *r.added]) for r in secrets.scan(single, model).collect()}
    for r in masked.collect():
        text, spans = before[r.doc_id]
        assert (r.text == text) == (not spans) and r.n_chars == len(r.text)
        assert all(text[s.start : s.end] not in r.text for s in spans)
    packed = corpus_pipeline.pack(spark, masked, SF).collect()
    assert {r.doc_id for r in packed} == set(before)


def test_odd_rows(spark, odd_docs, no_docs):
    """Nulls, empty and long texts and repeated rows through all stages: what remains is what the rules
    and the groups leave, each text once."""
    shape = "doc_id", "text", "lang", "'s' as source", "0L as n_chars"
    docs = odd_docs.selectExpr(*shape)
    expected = {r.text for r in docs.collect() if not failed(r.text)}
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        seen.append(docs.collect())
    assert {r.text for r in seen[0]} == expected
    assert sorted(r.text for r in seen[1]) == sorted(expected)  # no two of them are near, repeated rows leave
    assert [len(seen[i]) for i in (1, 2)] == [len(expected)] * 2
    assert {r.doc_id for r in seen[3]} == {r.doc_id for r in seen[2]}
    docs = no_docs.selectExpr(*shape)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def failed(text):
    words = (text or "").split()
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    return len(words) < 10 or 100 * len(covered) > 20 * len(words)


def test_run(spark, documents):
    """All stages over the table, hand-over included, against the stages by brute force."""
    from tokenizers import Tokenizer
    import public_tokenizers

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdicts = {r.doc_id: r.kept for r in quality.judge(documents, labels).collect()}
    rows = [(r.doc_id, r.text) for r in documents.collect() if verdicts[r.doc_id]]
    chosen = {d for d, (_, x) in brute(rows, 5, 80, 100).items() if x == d}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == chosen
    single = documents.where(documents.doc_id.isin(sorted(chosen)))
    texts = {r.doc_id: r.text for r in secrets.redact(single, secrets.default_model(single)).collect()}
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {d: len(model.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()}
    assert {r.doc_id: r.doc_tokens for r in got} == lengths
    assert sum(r.length for r in got) == sum(lengths.values())
