"""Quality rules whose cutoffs carry a guarantee on labelled data.

A base rule rejects documents of fewer than 10 words or with over a fifth of their words in repeated
five-word windows. Beyond it, every signal of a document (share of symbols, of repeated lines, of
capital letters, mean word length both ways, share of distinct words both ways) has a list of
candidate cutoffs. Per stratum (language), labelled texts are dealt by a hash of the text into two
halves; copies of a text are one trial, so trials are as independent as texts are. The
first half orders nothing but proposes: a cutoff is a candidate where it rejects bad documents more
often than good ones. On the second half (the holdout), the exact binomial test asks whether the cutoff's
false-rejection rate, the share of good documents it rejects, may still exceed alpha: with k
rejections among n good documents, p = P(Binomial(n, alpha) <= k). Holm's step-down correction over
all candidates of all strata keeps the chance of any uncertified cutoff passing below delta. Of a
stratum's certified cutoffs on a signal the strictest is applied. Each signal gets its equal share
of alpha, so the rules together falsely reject at most alpha of a stratum's good documents.

Only counts leave the executors: strata x signals x cutoffs numbers, for the max_strata strata with
the most good documents in the holdout; all others, labelled or not, share one common stratum, whose
guarantee is for its documents together.

Cases: a null or empty text has no words and fails the base rule; null strata form one stratum of
their own; null or absent labels don't count; a text whose labels differ, by copies or by repeated
labels, is a bad one; a stratum
of its own without enough labels has no certified cutoff and keeps all that passes the base rule; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import materialize, table

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Candidate cutoffs of each signal, from lax to strict; a document beyond the cutoff is rejected.
#: The sign says which side is bad: +1 above, -1 below.
SIGNALS: dict[str, tuple[int, list[float]]] = {
    "symbol_share": (1, [0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01]),
    "dup_line_share": (1, [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1]),
    "upper_share": (1, [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1]),
    "word_length_high": (1, [20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0]),
    "word_length_low": (-1, [1.5, 2.0, 2.5, 3.0, 3.5, 4.0]),
    "distinct_share_low": (-1, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4]),
    "digit_share": (1, [0.7, 0.5, 0.3, 0.2, 0.15, 0.1, 0.05, 0.03]),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_upper", "n_letters", "n_digits", "n_distinct", "n_lines"]
#: Windows of a text beyond which they are numbered, not written out.
LONG = 20_000
#: The common stratum of all that have none of their own.
REST = ()
_SPACES = bytes([32, *range(9, 14)])
_DIGITS = b"0123456789"
_OTHER = {kind: bytes(set(range(256)) - set(keep)) for kind, keep in (
    ("symbols", SYMBOLS.encode()), ("digits", _DIGITS), ("spaces", _SPACES),
    ("upper", bytes(range(65, 91))), ("letters", bytes([*range(65, 91), *range(97, 123)])),
    ("starts", bytes([*range(128), *range(192, 256)])),
)}


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of so many words that occurs twice or more."""
    count = len(words) - width + 1
    if count < 2:
        return 0
    if count > LONG:
        return _repeated_in_long(words, width)
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == count:
        return 0
    often = Counter(windows)
    covered, end = 0, 0
    for at, window in enumerate(windows):
        if often[window] > 1:
            covered += at + width - max(at, end)
            end = at + width
    return covered


def _repeated_in_long(words: list[bytes], width: int) -> int:
    """The same with windows numbered by doubling: a window is a pair of numbers of shorter ones, so
    a word costs a few integers and no window is ever written out."""
    known: dict[bytes, int] = {}
    single = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    del known
    number, size = single, 1
    while size < width:
        step = min(size, width - size)
        pairs = number[: len(words) - size - step + 1] * len(words) + number[step : len(words) - size + 1]
        number, size = np.unique(pairs, return_inverse=True)[1], size + step
    twice = np.bincount(number)[number] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[: len(twice)] += twice
    edges[width : width + len(twice)] -= twice
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """COUNTS and then MORE of one text."""
    data = text.encode()
    words = data.split()
    # bytes.split() also knows only the six ASCII spaces; code points are the bytes that start one
    word_chars = len(text) - len(data.translate(None, _OTHER["spaces"]))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in data.split(b"\n"):
        if not line or not line.strip():
            continue
        lines += 1
        if line in seen:
            dup += 1
        seen.add(line)
    counted = [len(data.translate(None, _OTHER[kind])) for kind in ("symbols", "upper", "letters", "digits")]
    symbols, upper, letters, digits = counted
    return len(words), word_chars, symbols, dup, repeated_words(words), upper, letters, digits, len(set(words)), lines


def _counted(rows: DataFrame, text: str) -> DataFrame:
    """rows with their text's counts in columns of their own names, which rows must not have."""
    names, at = [*COUNTS, *MORE], rows.columns.index(text)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(name, T.LongType()) for name in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t.as_py() or "") for t in batch.column(at)]
            columns = list(zip(*found)) if found else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], names=[*batch.schema.names, *names]
            )

    return rows.mapInArrow(run, schema)


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, copy (a hash of the text) and the counts of every document, in one pass over the texts."""
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"),
        F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("copy"), F.col(text).cast("string").alias("text"),
    )
    return _counted(rows, "text").drop("text")


def _signals() -> dict:
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "upper_share": share("n_upper", "n_letters"),
        "word_length_high": share("word_chars", "n_words"),
        "word_length_low": share("word_chars", "n_words"),
        # long texts repeat words anyway: the square root of the count is what may be expected at least
        "distinct_share_low": F.coalesce(F.try_divide(F.col("n_distinct"), F.pow(F.col("n_words"), F.lit(0.8))), F.lit(1.0)),
        "digit_share": share("n_digits", "word_chars"),
    }


def base_failed():
    """Fewer than 10 words, or over a fifth of the words repeated."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exactly up to rounding."""
    if k >= n:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def certify(counts: list[dict], alpha: float, delta: float) -> dict[tuple[str, str], float]:
    """Cutoff of each (stratum, signal) that passes. counts: a row for each stratum and cutoff with
    good and bad documents seen and rejected in the proposing half, good ones in the holdout."""
    share = alpha / len(SIGNALS)
    tested = []
    for row in counts:
        for signal, (_, cutoffs) in SIGNALS.items():
            for at, cutoff in enumerate(cutoffs):
                good, bad = row[f"pg_{signal}_{at}"], row[f"pb_{signal}_{at}"]
                if bad * max(1, row["pg"]) > 4 * good * max(1, row["pb"]):
                    p = binomial_tail(row[f"hg_{signal}_{at}"], row["hg"], share) if row["hg"] else 1.0
                    tested.append((p, row["stratum"], signal, at, cutoff))
    best: dict[tuple[str, str], tuple[int, float]] = {}
    for rank, (p, stratum, signal, at, cutoff) in enumerate(sorted(tested, key=lambda x: x[0])):
        if p > delta / (len(tested) - rank):
            break
        best[stratum, signal] = max(best.get((stratum, signal), (-1, 0.0)), (at, cutoff))
    return {k: v[1] for k, v in best.items()}


def thresholds(rows: DataFrame, labels: DataFrame, alpha: float, delta: float, max_strata: int) -> tuple[dict[tuple[str, str], float], list]:
    """Certified cutoffs from the measured rows that labels cover, both of which are read in full, and
    the strata that stand on their own."""
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    joined = rows.join(good.where("doc_id is not null and quality is not null"), "doc_id").where(~base_failed())
    # a text counts once, however many copies and labels it has
    trials = joined.groupBy("stratum", "copy").agg(F.min("quality").alias("quality"), *(F.first(x).alias(f"s_{n}") for n, x in _signals().items()))
    half = F.pmod(F.xxhash64(F.col("copy"), F.lit(17)), F.lit(2))
    sums = []
    for name, test in (("pg", (half == 0) & (F.col("quality") == 1)), ("pb", (half == 0) & (F.col("quality") == 0)), ("hg", (half == 1) & (F.col("quality") == 1))):
        sums.append(F.count_if(test).alias(name))
        for signal, (sign, cutoffs) in SIGNALS.items():
            value = F.col(f"s_{signal}")
            for at, cutoff in enumerate(cutoffs):
                sums.append(F.count_if(test & (value > cutoff if sign > 0 else value < cutoff)).alias(f"{name}_{signal}_{at}"))
    counted = materialize(trials.groupBy("stratum").agg(*sums), "strata")
    found = [r.asDict() for r in counted.orderBy(F.desc("hg"), "stratum").limit(max_strata).collect()]
    own = [r["stratum"] for r in found]
    others = counted.where(~_among(own))
    rest = others.agg(F.count("*").alias("strata"), *(F.sum(c).alias(c) for c in others.columns if c != "stratum")).first().asDict()
    if rest.pop("strata"):
        found.append(rest | {"stratum": REST})
    return certify(found, alpha, delta), own


def _among(own: list):
    """Whether a row's stratum, perhaps null, is one of own."""
    named = F.coalesce(F.col("stratum").isin([x for x in own if x is not None]), F.lit(False))
    return named | F.col("stratum").isNull() if None in own else named


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, max_strata: int = 256, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept. At most alpha of a stratum's good
    documents are rejected beyond the base rule, with probability 1 - delta. Strata beyond the
    max_strata with the most labels count as one."""
    rows = materialize(measured(docs, key, text, stratum), "quality")
    passes = _passes(*thresholds(rows, labels, alpha, delta, max_strata))
    return rows.select(F.col("doc_id").alias(key), *COUNTS, base_failed().alias("base_failed"), passes.alias("kept"))


def _passes(found: dict[tuple[str, str], float], own: list):
    """The verdict on a measured row. own: the strata that stand on their own."""
    reject = base_failed()
    signals = _signals()
    for (name, signal), cutoff in sorted(found.items(), key=lambda x: (x[0][0] or "", x[0][1])):
        sign = SIGNALS[signal][0]
        beyond = signals[signal] > cutoff if sign > 0 else signals[signal] < cutoff
        here = ~_among(own) if name == REST else F.col("stratum").eqNullSafe(F.lit(name))
        reject = reject | (here & beyond)
    return ~reject


def keep(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, max_strata: int = 256, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The documents that judge() keeps, with all their columns. The texts are read twice, once for
    the cutoffs and once for the verdicts; nothing is joined."""
    rows = materialize(measured(docs, key, text, stratum), "quality")
    passes = _passes(*thresholds(rows, labels, alpha, delta, max_strata))
    hidden = docs.select(F.struct("*").alias("_row"), F.col(stratum).cast("string").alias("stratum"))
    texts = hidden.select("_row", "stratum", F.col("_row").getField(text).cast("string").alias("_text"))
    return _counted(texts, "_text").where(passes).select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def op10_risk_controlled(spark, sf_dir) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return judge(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
