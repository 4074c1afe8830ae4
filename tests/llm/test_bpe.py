import base64
import random
from array import array

import public_tokenizers
import tiktoken

from freshet.llm import bpe


def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_tiktoken(documents, odd_docs):
    model = reference()
    own = bpe.coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    draw = random.Random(5)
    texts = [r.text or "" for r in documents.collect() + odd_docs.collect()]
    texts += ["".join(draw.choices(" \n\tab'sABC9.é　", k=draw.randrange(40))) for _ in range(3000)]
    for text in texts:
        ids = model.encode_ordinary(text)
        assert list(array("I", own.encode(text))) == ids
        assert own.decode(own.encode(text)) == text.encode()


def test_long_pretokens():
    model = reference()
    own = bpe.coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    draw = random.Random(6)
    for text in ("a" * 20_000, "".join(draw.choices("abcdef", k=30_000)), "中文" * 3000):
        assert list(array("I", own.encode(text))) == model.encode_ordinary(text)


def test_frames(odd_docs, no_docs):
    rows = bpe.round_trip(odd_docs).collect()
    assert len(rows) == 8
    by = {r.doc_id: r for r in rows}
    assert by[2].n_tokens == by[3].n_tokens == 0 and bytes(by[2].ids) == bytes(by[3].bytes) == b""
    assert bpe.round_trip(no_docs).count() == bpe.encode(no_docs).count() == 0
    decoded = {r.doc_id: bytes(r.bytes) for r in bpe.decode(bpe.encode(odd_docs)).collect()}
    assert decoded[6] == [r.text for r in odd_docs.collect() if r.doc_id == 6][0].encode()


def test_the_query(spark, documents):
    import hashlib

    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    from freshet.llm.bpe import op1_bpe_roundtrip

    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    for r in op1_bpe_roundtrip(spark, "/root/testdata/sf0.001").collect():
        ids = model.encode_ordinary(texts[r.doc_id])
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(data).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
