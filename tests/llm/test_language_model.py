import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from freshet.llm import language_model as lm


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) + [None]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


@pytest.fixture(scope="module")
def scored(documents):
    model = lm.train(documents.select("doc_id", "text"))
    return model, lm.score(documents.select("doc_id", "text"), model).collect()


def check_base(docs, rows):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    counts = Counter(w for d, t in texts if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = []
    for d, t in texts:
        words = tokens(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        expected.append((str(d), held(d), len(words), sum(w in counts for w in words), n, round(base, 4)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows]
    assert sorted(got) == sorted(expected)


def test_base_scores(documents, scored):
    check_base(documents, scored[1])


def test_odd_rows(odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text")
    check_base(docs, lm.score(docs, lm.train(docs)).collect())
    none = no_docs.select("doc_id", "text")
    assert lm.score(none, lm.train(none)).count() == 0


def test_better_than_the_base_on_held_out_words(scored):
    rows = [r for r in scored[1] if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_rare_words_by_join_score_as_by_table(documents, scored):
    """The same model with a head of only the context words scores alike."""
    model, rows = scored
    docs = documents.select("doc_id", "text")
    small = lm.train(docs, lm.Settings(head=model.settings.contexts - 2))
    assert len(small.order) < len(model.order)
    again = {r.doc_id: r.score for r in lm.score(docs, small).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-3 * abs(r.score) for r in rows)


def test_probabilities_of_a_context_add_up_to_one(scored):
    model, how = scored[0], scored[0].settings
    shares, samples = lm._shares(model), len(model.averaged)
    total = np.zeros(how.contexts)
    for batch in model.words.toArrow().to_batches():
        parent, own, places, _ = lm._predictive(batch, samples, shares, how)
        total += np.bincount(places, own, how.contexts) + (parent @ shares[0]).sum(axis=0) / samples
    unknown = (shares[2][:, 0] * shares[2][:, 1]) @ shares[0] / samples
    assert np.allclose(total + unknown, 1, atol=1e-9)


def test_seating_follows_its_conditional():
    logs = lm.stirling(0.5, 8)
    c, others, parent = 5, 3.0, 0.2
    weight = [math.exp(logs[c, t]) * math.prod(others + 0.5 * j for j in range(t)) * parent**t for t in range(1, c + 1)]
    n = 40_000
    got = np.bincount(lm.seat(np.full(n, c), np.full(n, others), np.full(n, parent), 0.5, lm.stirling(0.5), np.arange(n), 1), minlength=c + 1)[1:] / n
    assert np.allclose(got, np.array(weight) / sum(weight), atol=0.01)
    many = lm.seat(np.array([100_000, 1, 0]), np.full(3, 10.0), np.full(3, 0.01), 0.5, lm.stirling(0.5), np.arange(3), 2)
    assert 1 <= many[0] < 20_000 and many[1] == 1 and many[2] == 0


def test_binomial_draws():
    u = lm.drawn(np.arange(50_000), 3, 4)
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01
    for n, p in ((10, 0.3), (5000, 0.005), (7, 1.0), (9, 0.0)):
        got = lm.binomial(np.full(len(u), n), np.full(len(u), p), u)
        assert abs(got.mean() - n * p) < 0.05 * max(1, n * p) and abs(got.var() - n * p * (1 - p)) < 0.05 * max(1, n * p)


def plain_model(texts, sweeps, how, contexts):
    """Predictive probabilities of a franchise whose customers are seated one by one (Gibbs), averaged."""
    import random

    draw = random.Random(5)
    words = sorted({w for t in texts for w in t}, key=str)
    seats = {}  # (context, word): customers of each table
    root = {w: [] for w in words}
    uniform = 1 / (len(words) + 1)

    def root_chance(w):
        n, tables = sum(map(sum, root.values())), sum(map(len, root.values()))
        own = sum(root[w]) - how.root_discount * len(root[w]) if w in root else 0
        return (own + (how.root_strength + how.root_discount * tables) * uniform) / (how.root_strength + n)

    def sit(tables, discount, fresh):
        weights = [n - discount for n in tables] + [fresh]
        at = draw.choices(range(len(weights)), weights)[0]
        if at == len(tables):
            tables.append(0)
        tables[at] += 1
        return tables[at] == 1

    def leave(tables):
        at = draw.choices(range(len(tables)), tables)[0]
        tables[at] -= 1
        if not tables[at]:
            del tables[at]
            return True
        return False

    def count(c):
        return sum(len(x) for (o, _), x in seats.items() if o == c), sum(sum(x) for (o, _), x in seats.items() if o == c)

    tokens = [(contexts(t[i - 1] if i else None, not i), w) for t in texts for i, w in enumerate(t)]

    def enter(c, w):
        tables = seats.setdefault((c, w), [])
        if sit(tables, how.discount, (how.strength + how.discount * count(c)[0]) * root_chance(w)):
            sit(root[w], how.root_discount, (how.root_strength + how.root_discount * sum(map(len, root.values()))) * uniform)

    for c, w in tokens:
        enter(c, w)
    total, kept = {}, 0
    for sweep in range(sweeps):
        for c, w in tokens:
            if leave(seats[c, w]):
                leave(root[w])
            enter(c, w)
        if sweep >= sweeps // 4:
            kept += 1
            for c in {c for c, _ in tokens}:
                tables, n = count(c)
                for w in words:
                    own = seats.get((c, w), [])
                    chance = (sum(own) - how.discount * len(own) + (how.strength + how.discount * tables) * root_chance(w)) / (how.strength + n)
                    total[c, w] = total.get((c, w), 0) + chance
    return {k: v / kept for k, v in total.items()}


def test_against_seating_one_by_one(spark):
    how = lm.Settings(contexts=4, head=8, sweeps=160, burn_in=40, strength=1.0, root_strength=2.0)
    texts = ["a b a b c", "a b a d", "b a c a b a", "c c a b", "e a b"] * 2
    ids = [i for i in range(1000) if not held(i)][: len(texts)]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").coalesce(1)
    model = lm.train(docs, how)
    listed = [tokens(t) for t in texts]
    often = Counter(w for t in listed for w in t)
    shares, samples, top = lm._shares(model), len(model.averaged), model.order[np.argsort(model.head_rank)]
    from freshet.llm.text import word_hashes

    hashes = {w: int(word_hashes(w).view(np.int64)[0]) if w else int(lm.END) for w in often}
    places = {w: int(np.flatnonzero(top == hashes[w])[0]) for w in often}
    contexts = lambda before, first: 3 if first else places[before] if places[before] < 2 else 2
    expected = plain_model(listed, 3000, how, contexts)
    got = {}
    for batch in model.words.toArrow().to_batches():
        parent, own, where, owner = lm._predictive(batch, samples, shares, how)
        table = (parent @ shares[0]) / samples
        table[owner, where] += own
        for i, h in enumerate(batch.column("word").to_pylist()):
            word = next(w for w, x in hashes.items() if x == h)
            got |= {(c, word): table[i, c] for c in range(4)}
    assert max(abs(got[k] - v) for k, v in expected.items()) < 0.03


def test_same_scores_however_the_rows_are_dealt(spark, documents, scored):
    docs = documents.select("doc_id", "text").repartition(7)
    again = {r.doc_id: r.score for r in lm.score(docs, lm.train(docs)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-5 * abs(r.score) for r in scored[1])


def test_perplexity_and_the_query(spark, documents, scored, no_docs):
    rows = lm.op9_pitman_yor(spark, "/root/testdata/sf0.001")
    check_base(documents, rows.collect())
    unseen = rows.where("held_out")
    n = sum(r.n_tokens for r in scored[1] if r.held_out)
    total = sum(r.score for r in scored[1] if r.held_out)
    assert abs(lm.perplexity(unseen) / 10 ** (-total / n) - 1) < 1e-4
    assert lm.perplexity(rows.where("false")) is None


def test_every_previous_word_has_its_restaurant(spark):
    """Scores against customers seated one by one, with a restaurant for each previous word."""
    how = lm.Settings(sweeps=22, burn_in=6, strength=1.0, root_strength=2.0)
    texts = ["a b a b c", "a b a d", "b a c a b a", "c c a b", "e a b"] * 2
    ids = [i for i in range(1000) if not held(i)][: len(texts)]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").coalesce(1)
    assert how.every
    got = {r.doc_id: r.score for r in lm.score(docs, lm.train(docs, how)).collect()}
    listed = [tokens(t) for t in texts]
    expected = plain_model(listed, 3000, how, lambda before, first: "start" if first else before)
    for i, words in zip(ids, listed):
        score = sum(math.log10(expected["start" if not at else words[at - 1], w]) for at, w in enumerate(words))
        assert abs(got[i] - score) < 0.03 * len(words)


def test_contexts_beyond_any_number_are_told_apart(spark):
    """3,000 words, each before a word of its own, of equal frequency: none may share a restaurant."""
    ids, unseen = [i for i in range(9000) if not held(i)][:6000], [i for i in range(9000) if held(i)][:2]
    rows = [(i, f"left{at % 3000} right{at % 3000}") for at, i in enumerate(ids)]
    rows += [(unseen[0], " ".join(f"left{k} right{k}" for k in range(3000))), (unseen[1], " ".join(f"left{k} right{k + 1}" for k in range(2999)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    scores = {r.doc_id: r.score for r in lm.score(docs, lm.train(docs)).collect() if r.doc_id in unseen}
    # a pair is seen twice: its own customers add to the chance of every right word after its left one
    assert scores[unseen[0]] > scores[unseen[1]] + 2500


def test_steps_and_planes_give_the_numbers_back():
    for numbers in ([], [0], [3, 3, 700, 2**40, 2**64 - 1]):
        numbers = np.array(numbers, np.uint64)
        assert lm._stepped(lm._parcel(0, 0, 0, lm._steps(numbers)).column(3)[0], len(numbers)).tolist() == numbers.tolist()
    small = np.array([0, 5, 255], np.uint32)
    assert lm._planes(small).nbytes == 3 and lm._unplaned(lm._parcel(0, 0, 0, lm._planes(small)).column(3)[0], np.uint32, 3).tolist() == [0, 5, 255]


def test_listed_pairs_and_their_numbers_take_little_room(spark, documents):
    """A stored pair, and one asked for, is a step of less than the eight bytes of a hash; none is lost."""
    found = lm.pairs(documents.select("doc_id", "text"), None, 1).collect()
    batch = lm._parcel(0, lm.PAIRS, 0, *(np.frombuffer(found[0][c], np.uint8) for c in "abcdef"))
    own, wide, at, customers, words = lm._pairs_of([batch.column(k)[0] for k in range(3, 9)])
    texts = [(r.doc_id, tokens(r.text)) for r in documents.collect()]
    expected = Counter((w[i - 1] if i else "", x) for d, w in texts for i, x in enumerate(w) if not held(d))
    seen = {(w[i - 1] if i else "", x) for _, w in texts for i, x in enumerate(w)}
    assert len(found) == 1 and len(at) == len(seen) and wide.sum() == len(at)
    assert sorted(customers.tolist()) == sorted(expected[p] for p in seen)
    assert len(found[0]["c"]) <= 5 * len(at)
    owner, order = np.repeat(np.arange(len(own)), wide), np.sort(words)
    before, usual = lm._found(order, own)
    place, near = lm._found(order, words[at])
    numbers = lm._numbers(len(order), own[owner], before[owner], usual[owner], words[at], place, near)
    assert len(np.unique(numbers)) == len(at)
    assert lm._steps(np.sort(numbers[numbers < lm.HASHED])).nbytes < 8 * (numbers < lm.HASHED).sum()
