import math
import random
import re

from freshet.llm import quality


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_against_brute_force(odd_docs):
    draw = random.Random(1)
    texts = [r.text or "" for r in odd_docs.collect()]
    texts += ["".join(draw.choices(["a", "b", " ", " ", "\n", "#", "é", " "], k=draw.randrange(120))) for _ in range(500)]
    for text in texts:
        assert quality.measure(text)[:5] == slow(text)


def test_binomial_tail():
    for n, p in ((20, 0.1), (300, 0.02)):
        for k in (0, 1, 7):
            exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert abs(quality.binomial_tail(k, n, p) - exact) < 1e-9
    assert quality.binomial_tail(5, 5, 0.1) == 1.0


def test_certified_cutoffs_and_verdicts(spark):
    good = "plain words of a calm and quite ordinary text that nobody would ever want to lose at all"
    bad = "## ** $$ %% && || << >> ## junk ** more $$ and %% some && || words << >> ## ** $$"
    rows = [(i, (bad if i % 4 == 0 else good) + f" n{i}", "en" if i % 2 or i % 8 == 0 else "xx") for i in range(4000)]
    rows += [(9001, None, "en"), (9002, "", None), (9003, "too few", "en"), (9004, bad, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(4000)] + [(None, 1), (5, None)], "doc_id long, quality int")
    kept = {r.doc_id: r for r in quality.judge(docs, labels, alpha=0.2).collect()}
    assert len(kept) == len(rows)
    assert all(kept[i].kept for i in range(4000) if i % 4)
    assert not any(kept[i].kept for i in range(0, 4000, 8))
    assert not kept[9001].kept and kept[9002].base_failed and not kept[9003].kept
    assert kept[9004].kept  # a stratum without labels has no cutoff


def test_empty(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(no_docs, labels).count() == 0


def test_rare_strata_share_one(spark):
    good = "plain words of a calm and quite ordinary text that nobody would ever want to lose at all"
    bad = "## ** $$ %% && || << >> ## junk ** more $$ and %% some && || words << >> ## ** $$"
    # one large stratum of good texts, and many small ones (null among them), none certain by itself
    rows = [(i, good + f" n{i}", "en") for i in range(2000)]
    rows += [(10000 + i, (bad if i % 4 == 0 else good) + f" n{i}", f"x{i % 97}" if i % 97 else None) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(not t.startswith("##"))) for i, t, _ in rows], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.judge(docs, labels, alpha=0.2, max_strata=1).collect()}
    assert len(kept) == len(rows)
    assert all(kept[i] == (not t.startswith("##")) for i, t, _ in rows)
    left = quality.keep(docs, labels, alpha=0.2, max_strata=1)
    assert {r.doc_id for r in left.collect()} == {i for i, k in kept.items() if k}


def test_windows_of_long_texts():
    draw = random.Random(7)
    for n, kinds in ((60, 2), (200, 3), (300, 40), (5, 1), (400, 10**6)):
        for _ in range(20):
            words = [b"w%d" % draw.randrange(kinds) for _ in range(n)]
            grams = [tuple(words[i : i + 5]) for i in range(n - 4)]
            covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
            assert quality._repeated_in_long(words, 5) == len(covered)
            assert quality.repeated_words(words) == len(covered)


def verdicts(docs, labels, alpha, delta, hashes):
    """kept of every (doc_id, stratum, text), step by step: exact fractions, Holm by definition."""
    from fractions import Fraction

    names = [*quality.COUNTS, *quality.MORE]

    def signals(c):
        return {
            "symbol_share": c["n_symbols"] / c["word_chars"] if c["word_chars"] else 0.0,
            "dup_line_share": c["n_dup_lines"] / c["n_lines"] if c["n_lines"] else 0.0,
            "upper_share": c["n_upper"] / c["n_letters"] if c["n_letters"] else 0.0,
            "word_length_high": c["word_chars"] / c["n_words"] if c["n_words"] else 0.0,
            "word_length_low": c["word_chars"] / c["n_words"] if c["n_words"] else 0.0,
            "distinct_share_low": c["n_distinct"] / c["n_words"] ** 0.8 if c["n_words"] else 1.0,
            "digit_share": c["n_digits"] / c["word_chars"] if c["word_chars"] else 0.0,
        }

    beyond = lambda signal, value, cutoff: value > cutoff if quality.SIGNALS[signal][0] > 0 else value < cutoff
    counts = {t: dict(zip(names, quality.measure(t or ""))) for _, _, t in docs}
    failed = {t: c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"] for t, c in counts.items()}
    trials = {}
    for doc_id, stratum, text in docs:
        for label in labels.get(doc_id, ()):
            if doc_id is not None and label is not None and not failed[text]:
                trials[stratum, text] = min(label, trials.get((stratum, text), 1))
    share = Fraction(alpha).limit_denominator(10**6) / len(quality.SIGNALS)
    tests = []
    for stratum in {s for s, _ in trials}:
        halves = {h: [(signals(counts[t]), q) for (s, t), q in trials.items() if s == stratum and hashes[t or ""] == h] for h in (0, 1)}
        for signal, (_, cutoffs) in quality.SIGNALS.items():
            for at, cutoff in enumerate(cutoffs):
                seen = {q: [beyond(signal, v[signal], cutoff) for v, label in halves[0] if label == q] for q in (0, 1)}
                if sum(seen[0]) * max(1, len(seen[1])) > 4 * sum(seen[1]) * max(1, len(seen[0])):
                    held = [beyond(signal, v[signal], cutoff) for v, label in halves[1] if label == 1]
                    n, k = len(held), sum(held)
                    p = sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1)) if n else 1
                    tests.append((float(p), stratum, signal, at))
    tests.sort(key=lambda x: x[0])
    passed = {}
    for i, (p, stratum, signal, at) in enumerate(tests):
        if p * (len(tests) - i) > delta:
            break
        passed[stratum, signal] = max(at, passed.get((stratum, signal), -1))
    out = []
    for _, stratum, text in docs:
        values = signals(counts[text])
        hit = any(s == stratum and beyond(g, values[g], quality.SIGNALS[g][1][at]) for (s, g), at in passed.items())
        out.append(not failed[text] and not hit)
    return out, passed


def test_verdicts_against_plain_holm(spark, documents):
    from pyspark.sql import functions as F

    draw = random.Random(12)
    words = [f"word{i}" for i in range(300)]
    made = []
    for i in range(3000):
        bad = i % 5 == 0
        text = " ".join(draw.choices(words, k=25)) + (" # $ % & | < >" * 3 if bad and i % 2 else " 123456789" * 9 if bad else "")
        made.append((10**6 + i, "en" if i % 3 else "de", text, int(not bad) if i % 7 else 1))
    made += [(2 * 10**6 + i, "en", made[1][2], 0) for i in range(30)]  # copies of one text, labelled otherwise
    docs = documents.select("doc_id", "lang", "text").union(spark.createDataFrame([r[:3] for r in made], "doc_id long, lang string, text string"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality").union(
        spark.createDataFrame([(r[0], r[3]) for r in made], "doc_id long, quality int")
    )
    rows = [tuple(r) for r in docs.select("doc_id", "lang", "text").collect()]
    half = F.pmod(F.xxhash64(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(17)), F.lit(2))
    hashes = {r[0] or "": r[1] for r in docs.select("text", half).distinct().collect()}
    named = {}
    for r in labels.collect():
        named.setdefault(r.doc_id, []).append(r.quality)
    expected, passed = verdicts(rows, named, 0.2, 0.05, hashes)
    assert len(passed) >= 2
    got = {r.doc_id: r.kept for r in quality.judge(docs, labels, alpha=0.2).collect()}
    assert [got[d] for d, _, _ in rows] == expected


def test_the_query(spark, documents):
    rows = {r.doc_id: r for r in quality.op10_risk_controlled(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    assert set(rows) == set(texts)
    for doc_id, r in rows.items():
        n, chars, symbols, dup, repeat = slow(texts[doc_id]) if len(texts[doc_id]) < 5000 else quality.measure(texts[doc_id])[:5]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n) and not (r.base_failed and r.kept)
