"""Secret scans: fixed patterns, and character Markov models of random strings and identifiers.

DataFrame functions only. Positions come from splitting a text at the matches of a pattern: the
lengths of the parts and of the matches, added up, are the matches' offsets in code points. Running
sums, cuts and maskings work block by block, so a text with very many matches costs in proportion to
its length.

The models are tables of log probabilities of a character after another, one for each kind of random
string (lower-case hexadecimal, upper-case and digits, letters and digits, base64) and of ordinary
string (names in code and paths, words of the corpus, UUIDs, dates and versions, repeated and
consecutive characters). A length has its own probability in each. The log-likelihood
ratio of a run of 16 or more token characters is its best random model's less its best ordinary one's. A run whose ratio exceeds the threshold is a secret of
kind `markov`. The labelled samples are drawn from hashes, the ordinary ones by joining words of a
fixed list and words under 16 characters of some documents: what may be reported never teaches the
models, nor moves the threshold. The threshold is the quantile of the ratios of ordinary strings held
out from training that keeps false reports at `false_rate` of every kind, and log 1000 at least. Runs
without a letter are numbers or rules and not judged. What the fixed patterns cover is not judged
again; what is left of a run that begins or ends at their spans is, however short.

Cases: a null or empty text has no spans; null ids are kept; repeated rows are scanned each on its
own; an empty table gives an empty result, and without documents the ordinary strings are made of the
fixed words; extra columns are not read, except that redact() passes them through.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import materialize, table

#: Kinds in order, their patterns, and the least length (of a group, or of the whole match at 0).
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: What the models judge: whole runs of token characters; beside GAP (a span of the fixed patterns) of any length.
_T, GAP, OTHER = "[A-Za-z0-9+/_=-]", "\ue000", "\ue001"
RUN = f"(?<!{_T})(?:{_T}{{16,}}|(?<={GAP}){_T}+|{_T}+(?={GAP}))"
LONG = f"(?<!{_T}){_T}{{16,}}"
SHORT = r"(?<![A-Za-z])[A-Za-z]{3,15}(?![A-Za-z])"
MASK = "[SECRET]"
#: Elements and characters of a block.
_BLOCK, _CUT = 128, 2048
_SPAN = "array<struct<start:int,rank:int,end:int>>"
#: Token characters and what stands for both ends of a string, coded by their place here, from code point CODED on.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-,"
_WIDE, _END, _CODED = len(ALPHABET), ",", 0x100
#: Lengths told apart.
_LENGTHS = 64
#: Ordinary words of names in code.
CODE_WORDS = (
    "user account name get set find list item order store cache page session request response client server handler manager"
    " service factory builder parser reader writer buffer stream thread process config option value index count size length"
    " width height color image file path folder document section chapter figure table column row cell header footer body text"
    " string number date time stamp version release build test debug error warning info message event queue task worker job"
    " schedule update delete create insert select query result data base model view controller module package import export"
    " library utils common core lang org apache unknown linux windows gnu source target main default static public private"
    " internal local remote host port network address mail image content type length encode decode format layout style theme"
    " button window dialog panel menu label input output print load save open close start stop begin end first last next"
    " previous parent child node tree graph edge link map filter sort merge split join group total average max min"
).split()


@dataclass(frozen=True)
class Model:
    """logs[kind][68 * a + b]: log P(b after a) in strings of a kind; lengths[kind][n]: log P(n
    characters), the last for all longer ones, both in hundredths; the threshold of the ratio."""

    logs: dict[str, tuple[int, ...]]
    lengths: dict[str, tuple[int, ...]]
    threshold: float


#: Kinds of random and of ordinary strings.
RANDOM = ["hex", "upper", "letters", "base64"]
ORDINARY = ["code", "words", "uuid", "stamp", "steps"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _draw(salt: int, n: int) -> Column:
    """A number below n, by a hash of the id."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(n)).cast("int")


def _random(spark: SparkSession, n: int) -> DataFrame:
    sha = F.unhex(F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 512))
    b64 = F.base64(sha)
    letters = F.regexp_replace(b64, "[+/=]", "")
    kinds = [F.lower(F.hex(sha)), F.regexp_replace(F.upper(letters), "[^A-Z0-9]", ""), letters, b64]
    return spark.range(n).select(
        F.lit(True).alias("random"), F.element_at(F.array(*map(F.lit, RANDOM)), (F.col("id") % 4 + 1).cast("int")).alias("kind"),
        F.substring(F.element_at(F.array(*kinds), (F.col("id") % 4 + 1).cast("int")), F.lit(1), 16 + _draw(1, 33)).alias("value"),
    )


def _ordinary(spark: SparkSession, n: int, words: list[str]) -> DataFrame:
    """Strings of the kinds of ORDINARY in turn. words: of the corpus."""
    # one literal each: an array of thousands of literals is a plan of thousands of nodes
    code, own = (F.split(F.lit(" ".join(x)), " ") for x in (CODE_WORDS, words or CODE_WORDS))

    def word(i: int) -> Column:
        any_ = F.when(_draw(i, 3) > 0, F.get(code, _draw(20 + i, len(CODE_WORDS)))).otherwise(F.get(own, _draw(40 + i, len(words or CODE_WORDS))))
        digits = F.when(_draw(60 + i, 6) == 0, F.pow(F.lit(10.0), _draw(80 + i, 4) + 0.5).cast("int").cast("string")).otherwise(F.lit(""))
        return F.concat(F.lower(any_), digits)

    parts = [word(i) for i in range(6)]
    used = F.slice(F.array(*parts), F.lit(1), 2 + _draw(2, 5))
    title = F.transform(used, F.initcap)
    camel = F.concat(F.get(used, F.lit(0)), F.array_join(F.slice(title, F.lit(2), F.lit(9)), ""))
    mixed = F.aggregate(
        F.transform(used, lambda w, i: F.struct(w.alias("w"), F.when(F.pmod(F.hash(w, i), F.lit(2)) == 0, F.lit("/")).otherwise(F.lit("_")).alias("s"))),
        F.lit(""), lambda t, x: F.concat(t, F.when(t == "", F.lit("")).otherwise(x["s"]), x["w"]),
    )
    styles = [
        camel, F.array_join(title, ""), F.array_join(used, "_"), F.array_join(used, "-"), F.array_join(used, "/"), mixed,
        F.upper(F.array_join(used, "_")), F.concat(F.array_join(F.slice(used, F.lit(1), F.lit(2)), "/"), F.lit("/"), F.array_join(title, "")),
    ]
    glued = F.array_join(F.transform(F.array(*(F.get(own, _draw(90 + i, len(words or CODE_WORDS))) for i in range(4))), F.lower), "")
    sha = F.sha2(F.concat(F.lit("ordinary "), F.col("id").cast("string")), 256)
    part = lambda a, b: F.substring(sha, a, b)
    uuid = F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("4"), part(13, 3)), part(17, 4), part(21, 12))
    uuid = F.when(_draw(3, 4) == 0, F.upper(uuid)).otherwise(uuid)
    day = F.date_add(F.lit("1990-01-01").cast("date"), _draw(4, 20000)).cast("string")
    two = lambda i, n: F.lpad(_draw(i, n).cast("string"), 2, "0")
    stamp = F.concat(day, F.lit("T"), two(5, 24), F.lit("-"), two(6, 60), F.lit("-"), two(7, 60))
    stamp = F.when(_draw(8, 2) == 0, F.concat(F.translate(stamp, "-", ""), F.lit("Z"))).otherwise(F.concat(word(0), F.lit("-"), stamp))
    line = "".join(map(chr, range(97, 123))) + "".join(map(chr, range(65, 91))) + "".join(map(chr, range(48, 58))) * 2
    same = F.repeat(F.substring(F.lit(line), 1 + _draw(9, len(line)), F.lit(1)), 16 + _draw(10, 30))
    steps = F.when(_draw(11, 2) == 0, same).otherwise(F.substring(F.lit(line * 2), 1 + _draw(12, len(line)), 16 + _draw(13, 20)))
    kinds = [F.get(F.array(*styles), _draw(14, len(styles))), glued, uuid, stamp, steps]
    at = F.pmod(F.col("id"), F.lit(len(ORDINARY))).cast("int")
    return spark.range(n).select(F.lit(False).alias("random"), F.get(F.array(*map(F.lit, ORDINARY)), at).alias("kind"), F.get(F.array(*kinds), at).alias("value"))


def sample_words(docs: DataFrame, sample_docs: int = 2000, sample_words: int = 2000, key: str = "doc_id", text: str = "text") -> list[str]:
    """At most sample_words words of 3 to 15 letters from about sample_docs documents, chosen by a hash
    of the id, outside fixed-pattern spans and runs that may be judged. Words reach the list by a hash
    of their own."""
    share = max(1, docs.count() // max(1, sample_docs))
    chosen = docs.where(F.pmod(F.xxhash64(F.col(key)), F.lit(share)) == 0).select(F.col(text).cast("string").alias("text"))
    cleaned = F.regexp_replace("text", LONG, " ")
    for _, pattern, _, _ in KINDS:
        cleaned = F.regexp_replace(cleaned, pattern, " ")
    words = chosen.select(F.explode(F.regexp_extract_all(cleaned, F.lit(SHORT), F.lit(0))).alias("word")).groupBy("word").count()
    return [r[0] for r in words.orderBy(F.xxhash64("word"), "word").limit(sample_words).collect()]


def labelled_samples(spark: SparkSession, words: list[str], random_strings: int = 16_000, ordinary_strings: int = 20_000) -> DataFrame:
    """(random, kind, value, held): strings drawn by hashes; a quarter is held out."""
    drawn = materialize(_random(spark, random_strings).unionByName(_ordinary(spark, ordinary_strings, words)), "samples")
    return drawn.withColumn("held", F.pmod(F.xxhash64("value"), F.lit(4)) == 0)


def fit(samples: DataFrame, false_rate: float = 0.002, least: float = math.log(1000)) -> Model:
    """Train a model of every kind from labelled strings (random, kind, value, held; held ones set the
    threshold). Character pairs are counted by the cluster; at most 68 * 68 counts a kind reach the
    driver. Kinds without strings have a uniform model."""
    samples = samples.where("value is not null and random is not null")
    # a string's length is counted behind the pairs
    size = F.least(F.length("value"), F.lit(_LENGTHS - 1)) + _WIDE * _WIDE
    seen = F.concat(_pairs(F.col("value")), F.array(size))
    found = samples.where("not held").select("kind", F.explode(seen).alias("pair")).where("pair is not null").groupBy("kind", "pair").count().collect()
    counts = {kind: [0.0] * (_WIDE * _WIDE + _LENGTHS) for kind in RANDOM + ORDINARY}
    for r in found:
        if 0 <= r["pair"] < _WIDE * _WIDE + _LENGTHS:
            counts[r["kind"]][r["pair"]] = float(r["count"])
    logs, lengths = {}, {}
    for kind, own in counts.items():
        rows = [sum(own[a * _WIDE : (a + 1) * _WIDE]) for a in range(_WIDE)]
        logs[kind] = tuple(round(100 * math.log((c + 0.2) / (rows[i // _WIDE] + 0.2 * _WIDE))) for i, c in enumerate(own[: _WIDE * _WIDE]))
        n = sum(own[_WIDE * _WIDE :])
        lengths[kind] = tuple(round(100 * math.log((c + 0.2) / (n + 0.2 * _LENGTHS))) for c in own[_WIDE * _WIDE :])
    model = Model(logs, lengths, least)
    held = samples.where("held and not random and length(value) >= 16").select("kind", ratio(F.col("value"), model).alias("ratio"))
    tops = held.groupBy("kind").agg(F.percentile("ratio", F.lit(1 - false_rate)).alias("top")).collect()
    return Model(logs, lengths, max([least, *(r["top"] for r in tops)]))


def _pairs(value: Column) -> Column:
    """Codes of a string's neighbouring characters, its ends included."""
    codes = "".join(map(chr, range(_CODED, _CODED + _WIDE)))
    coded = F.transform(F.split(F.translate(F.concat(F.lit(_END), value, F.lit(_END)), ALPHABET, codes), ""), lambda c: F.ascii(c) - _CODED)
    return _let(coded, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c)), lambda a, b: a * _WIDE + b))


def ratio(value: Column, model: Model) -> Column:
    """Log-likelihood ratio of one string of token characters: the best random model's less the best
    ordinary one's."""

    def numbers(values):
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")

    def total(kind):
        known, sizes = numbers(model.logs[kind]), numbers(model.lengths[kind])
        # as many pairs as characters, and one
        size = lambda pairs: F.get(sizes, F.least(F.size(pairs) - 1, F.lit(_LENGTHS - 1)))
        return lambda pairs: F.aggregate(pairs, size(pairs).cast("long"), lambda t, x: t + F.coalesce(F.get(known, x), F.lit(0)))

    sums = [(kind, total(kind)) for kind in RANDOM + ORDINARY]
    both = lambda p: F.greatest(*(t(p) for k, t in sums if k in RANDOM)) - F.greatest(*(t(p) for k, t in sums if k in ORDINARY))
    return _let(_pairs(value), both) / 100.0


def _running(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """What came before each number of an array, added up by plus (of zero and above, zero the least):
    block by block, so that no long array is copied for every element."""

    def scan(block):
        start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("out"))
        step = lambda s, x: F.struct(plus(s["total"], x).alias("total"), F.concat(s["out"], F.array(s["total"])).alias("out"))
        return F.aggregate(block, start, step)

    def whole(v):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda i: scan(F.slice(v, i * _BLOCK + 1, F.lit(_BLOCK))))
        return _let(
            blocks,
            lambda b: _let(
                scan(F.transform(b, lambda x: x["total"]))["out"],
                lambda firsts: F.flatten(F.transform(b, lambda x, i: F.transform(x["out"], lambda y: plus(F.get(firsts, i), y)))),
            ),
        )

    return _let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<int>")))


def _found(text: Column, pattern: str, rank: int, passes) -> Column:
    """Spans of a pattern's matches that pass, in order."""

    def spans(matches, parts):
        steps = F.transform(matches, lambda m, i: F.length(F.get(parts, i)) + F.length(m))
        return _let(
            _running(steps, lambda a, b: a + b),
            lambda before: F.filter(
                F.transform(
                    matches,
                    lambda m, i: _let(
                        F.get(before, i) + F.length(F.get(parts, i)),
                        lambda at: F.when(passes(m), F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + F.length(m)).alias("end"))),
                    ),
                ),
                lambda x: x.isNotNull(),
            ),
        )

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: _let(F.split(text, pattern, -1), lambda p: spans(m, p)))
    return F.when(text.rlike(pattern), found).otherwise(F.array()).cast(_SPAN)


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of a text that is given in blocks of _CUT."""
    last = F.greatest(F.floor((end - 1) / _CUT).cast("int"), F.floor(start / _CUT).cast("int"))
    piece = lambda k: F.substring(F.get(blocks, k), F.greatest(start - k * _CUT, F.lit(0)) + 1, F.least(end - k * _CUT, F.lit(_CUT)) - F.greatest(start - k * _CUT, F.lit(0)))
    joined = F.array_join(F.transform(F.sequence(F.floor(start / _CUT).cast("int"), last), piece), "")
    return F.when(end > start, joined).otherwise(F.lit(""))


def _masked(text: Column, spans: Column, mask: Callable[[Column], Column]) -> Column:
    """text with each group of spans that overlap or touch replaced by mask(its length); spans are in order."""

    def gaps(ends, size):
        """(from, to) of what lies before each group, and after the last one."""
        reach = _running(F.transform(spans, lambda s: s["end"]), F.greatest)
        after = F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("from"), size.alias("to"))
        return _let(
            reach,
            lambda r: F.concat(
                F.filter(
                    F.transform(spans, lambda s, i: F.when((i == 0) | (s["start"] > F.get(r, i)), F.struct(F.get(r, i).alias("from"), s["start"].alias("to")))),
                    lambda x: x.isNotNull(),
                ),
                F.array(after),
            ),
        )

    def joined(blocks, between):
        def part(gap, i):
            following = F.get(between, i + 1)
            own = F.when(following.isNotNull(), mask(following["from"] - gap["to"])).otherwise(F.lit(""))
            return F.concat(_cut(blocks, gap["from"], gap["to"]), own)

        return F.array_join(F.transform(between, part), "")

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CUT}}}"), F.lit(0))
    return _let(blocks, lambda b: _let(gaps(spans, F.length(text)), lambda g: joined(b, g)))


def _spare(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name = "_" + name
    return name


def _fixed(text: Column) -> Column:
    """Spans of the fixed patterns."""
    kinds = []
    for rank, (_, pattern, group, least) in enumerate(KINDS):
        if group:
            passes = lambda m, p=pattern, g=group, n=least: F.length(F.regexp_extract(m, p, g)) >= n
        else:
            passes = lambda m, n=least: F.length(m) >= n
        kinds.append(_found(text, pattern, rank, passes))
    return F.array_sort(F.concat(*kinds))


def _scanned(docs: DataFrame, model: Model, text: str, base: str, added: str) -> DataFrame:
    """docs with two more columns. Each step is a column of its own that the next ones use more than
    once, so none is computed again."""
    whole, left = _spare(docs, "whole"), _spare(docs, "left")
    out = docs.withColumn(whole, F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = out.withColumn(base, _fixed(F.col(whole)))
    gaps = _masked(F.translate(F.col(whole), GAP, OTHER), F.col(base), lambda n: F.repeat(F.lit(GAP), n))
    out = out.withColumn(left, F.when(F.size(base) > 0, gaps).otherwise(F.col(whole)))

    def secret(value):
        return F.when(value.rlike("[A-Za-z]"), ratio(value, model) > model.threshold).otherwise(False)

    return out.withColumn(added, _found(F.col(left), RUN, len(KINDS), secret)).drop(whole, left)


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with base and added (which replace columns so named): arrays of (start, rank, end), by
    start and then kind; ranks follow KINDS, and the models' spans have the rank after the last."""
    return _scanned(docs.drop(*({"base", "added"} - {text})), model, text, "base", "added")


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with every span replaced by MASK; spans that overlap or touch are replaced as one."""
    base, added, spans = (_spare(docs, name) for name in ("base", "added", "spans"))
    out = _scanned(docs, model, text, base, added).withColumn(spans, F.array_sort(F.concat(base, added)))
    own = F.col(text).cast("string")
    changed = F.when(F.size(spans) > 0, _masked(own, F.col(spans), lambda n: F.lit(MASK))).otherwise(own)
    return out.withColumn(text, changed).drop(base, added, spans)


def default_model(docs: DataFrame) -> Model:
    """All models, trained from labelled_samples with words of the documents."""
    return fit(labelled_samples(docs.sparkSession, sample_words(docs)))


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS), F.lit("markov"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = scan(docs, default_model(docs)).select("doc_id", "base", "added")
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", *(count(i).alias(f"n_{k[0]}") for i, k in enumerate(KINDS)),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
