from array import array
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from freshet.llm import packing
from freshet.llm.packing import Packer, pack


def whole(rows, window, texts):
    """Every id of every document in one piece; gapless offsets; full windows or powers of two."""
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and len(p.ids) == 4 * p.length
            at += p.length
        assert at == window or at & (at - 1) == 0 and at < window
    for doc_id, text in texts.items():
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        got, copies = [], docs[doc_id]
        assert sum(p.length for p in copies) % len(ids) == 0
        if len({(p.start, p.sequence_id) for p in copies}) == len({p.start for p in copies}):
            for p in sorted(copies, key=lambda p: p.start):
                assert p.start == len(got) and p.doc_tokens == len(ids)
                got += array("I", bytes(p.ids))
            assert got == ids


def test_documents(documents, odd_docs):
    for docs in (documents, odd_docs):
        texts = {r.doc_id: r.text for r in docs.collect()}
        whole(pack(docs).collect(), 4096, texts)
        whole(pack(docs, window=64, max_open=3).collect(), 64, texts)


def test_empty(no_docs):
    assert pack(no_docs).count() == 0


def test_level_choice():
    """Each remainder goes where the sum of squared level counts ends up least."""
    import random

    draw = random.Random(3)
    packer = Packer(16, lambda *_: None)
    for i in range(500):
        size = draw.randrange(1, 16)
        counts = packer.level_counts.copy()

        def after(level):
            new = counts.copy()
            if level:
                new[level] -= 1
            if level + size < 16:
                new[level + size] += 1
            return int((new**2).sum())

        options = [after(h) for h in range(16) if (h == 0 or counts[h]) and h + size <= 16]
        packer.place((i, 0, b"\0" * 4 * size, size))
        assert int((packer.level_counts**2).sum()) == min(options)


def test_same_ids_as_the_library(documents):
    import random

    from freshet.llm.packing import piece_tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model, own = Tokenizer.from_file(path), piece_tokenizer(path)
    draw = random.Random(8)
    texts = [r.text for r in documents.collect()]
    texts += ["".join(map(chr, draw.choices(range(256), k=30))) for _ in range(3000)]
    texts += ["".join(draw.choices("I'LL don'T 're <|endoftext|> _-²½ªÀß\xa0\x85\x1c\n", k=25)) for _ in range(2000)]
    texts += ["ΑΣ Σ é İstanbul 中文", "'s's 'LL''d"]
    for text in texts:
        assert list(array("I", own.encode(text))) == model.encode(text, add_special_tokens=False).ids
    assert list(array("I", b"".join(own.encode_all(texts)))) == [i for t in texts for i in model.encode(t, add_special_tokens=False).ids]


def test_other_files_are_left_to_the_library(tmp_path, documents):
    import json

    from freshet.llm.packing import PieceTokenizer

    said = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    said["normalizer"]["normalizers"].pop()
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(said))
    model, own = Tokenizer.from_file(str(path)), PieceTokenizer(str(path))
    assert not own.plain
    for r in documents.limit(20).collect():
        assert list(array("I", own.encode(r.text or "X"))) == model.encode(r.text or "X", add_special_tokens=False).ids


def test_the_query(spark, documents):
    import zlib

    from freshet.llm.packing import op8_sum_of_squares

    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = op8_sum_of_squares(spark, "/root/testdata/sf0.001").collect()
    model, sequences = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list)
    for r in rows:
        ids = [*model.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(array("I", ids[r.start : r.start + r.length]).tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
    for pieces in sequences.values():
        ends = [0, *(o + n for o, n in sorted(pieces))]
        assert [o for o, _ in sorted(pieces)] == ends[:-1]
        assert ends[-1] == 4096 or ends[-1] & (ends[-1] - 1) == 0


def test_a_larger_memory_learns_less_and_gives_the_same_ids(monkeypatch):
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(at, at + 400)) for at in (0, 400, 800, 1200, 0, 400, 800)]
    learnt = {}
    for most in (100, packing.KNOWN_ALONE):
        tokenizer = packing.PieceTokenizer(public_tokenizers.path("word_bpe_49k.json"))
        tokenizer.most, asked, learn = most, [], tokenizer._learn
        monkeypatch.setattr(tokenizer, "_learn", lambda pieces: asked.extend(pieces) or learn(pieces))
        learnt[most] = ([tokenizer.encode(text) for text in texts], len(asked))
    (ids, few), (same, once) = learnt[packing.KNOWN_ALONE], learnt[100]
    assert ids == same and few == 1600 < once


def test_new_words_are_encoded_in_short_lines():
    path = public_tokenizers.path("word_bpe_49k.json")
    model, own = Tokenizer.from_file(path), packing.PieceTokenizer(path)
    lines, library = [], own.words

    class Watched:
        def encode_batch_fast(self, texts, **more):
            lines.extend(texts)
            return library.encode_batch_fast(texts, **more)

    own.words = Watched()
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400))
    assert list(array("I", own.encode(text))) == model.encode(text, add_special_tokens=False).ids
    assert len(lines) > 1 and max(len(line.split()) for line in lines) <= packing.LINE
