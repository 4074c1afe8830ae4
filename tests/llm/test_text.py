import random
import re

import pyarrow as pa

from freshet.llm import text


def words(value):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), value or ""))


def test_equal_words_and_only_they_hash_alike(monkeypatch):
    monkeypatch.setattr(text, "HASH_BYTES", 500)
    draw = random.Random(3)
    texts = ["".join(draw.choices(["a", "B", "b", " ", "\t", "\n", "\x0b", "é", "É", "\x1c", "\x85", " ", "word", "x" * 9, "ab" * 40], k=draw.randrange(60))) for _ in range(800)]
    texts += ["", None, " ", "x" * 20_000 + " " + "X" * 20_000, "\U0001f600 \U0001f600"]
    column = pa.array(["lead", *texts]).slice(1)
    known, at = {}, 0
    for hashes, counts in text.hashed_words(column):
        begin = 0
        for n in counts.tolist():
            own = words(texts[at])
            assert n == len(own)
            for word, h in zip(own, hashes[begin : begin + n].tolist()):
                assert known.setdefault(word, h) == h
            assert text.word_hashes(texts[at] or "").tolist() == hashes[begin : begin + n].tolist()
            begin, at = begin + n, at + 1
    assert at == len(texts) and len(set(known.values())) == len(known)
    assert list(text.hashed_words(pa.array([], pa.string()))) == []
