"""Secret scans: fixed patterns, and strings that look random to character Markov models.

Two first-order character models are trained from labelled samples: one from values that the fixed patterns found, one from
the ordinary identifiers and words of texts. A token's log-likelihood ratio, added up over its characters, tells which it
resembles. Tokens are judged from the least length of a base value on. The ratio that convicts is set for each class of
lengths by the false alarms on ordinary tokens of other documents than those the models learned from. All texts teach or
calibrate. DataFrame functions only; to train, texts are shuffled once so that repeated rows count once.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base kinds: expression, and the least length of its last group or of the whole.
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
LEAST_VALUE = 8
KINDS = ["assign", "access", "hex", "random"]

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
#: Tokens of the base values' least length or more. The models judge them all but words of less than 20 characters: letters
#: of which none after the first is upper case. Among these they would tell one random string in ten from a rare word.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}"
PLAIN = r"[A-Za-z][a-z]{7,18}(?![A-Za-z0-9+/_=-])"
JUDGED = rf"(?<![A-Za-z0-9+/_=-])(?!{PLAIN})[A-Za-z0-9+/_=-]{{8,}}"
#: These teach what is ordinary, whatever their length.
IDENTIFIER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9_-]{4,}(?![A-Za-z0-9+/_=-])"
PULL = 10.0
#: The share of ordinary tokens that may be convicted, and the first lengths of the classes that have their own ratio.
FALSE_ALARMS = 1e-4
CLASSES = (8, 10, 12, 16, 20)
#: The natural logarithm of the ratio that convicts lies between these, and is at least so much per character. An ordinary
#: token reaches the ratio r with a chance of 1 / r at most if its model holds. Above the upper bound, what a sample holds
#: are secrets without a label, not ordinary tokens.
LEAST_RATIO, MOST_RATIO, PER_CHARACTER = 9.0, 20.0, 0.5
#: Buckets per unit in the histogram of ratios, and matches whose places are added up at a time.
FINE, CHUNK = 8, 256


class Models(NamedTuple):
    """`ratio`: of every step, its log-likelihood ratio (random against ordinary); `cuts`: per class, the sum that convicts."""

    ratio: list[float]
    cuts: list[float]


def _found(text: Column, pattern: str) -> tuple[Column, Column]:
    """(matches, parts of the text between them)."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _before(parts: Column, first: Column, gap, whole) -> Column:
    """Per part: `first`, the wholes of the parts before it, and its own gap."""
    zero = F.struct(first.alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(parts, zero, lambda acc, x: F.struct(
        (acc["at"] + whole(x)).alias("at"), F.array_append(acc["starts"], acc["at"] + gap(x)).alias("starts")),
        lambda acc: acc["starts"])


def _both(x: Column) -> Column:
    return x["gap"] + x["own"]


def _chunks(lengths: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(lengths), F.lit(1)) - 1) / CHUNK).cast("int")),
                       lambda c: F.slice(lengths, c * CHUNK + 1, CHUNK))


def _heads(chunks: Column) -> Column:
    """The code point at which each chunk starts."""
    return _before(chunks, F.lit(0), lambda c: F.lit(0), lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + _both(x)))


def _inside(chunks: Column, heads: Column) -> Column:
    """The code point at which each match starts. Chunk by chunk the time grows with the number of matches, not its square."""
    return F.flatten(F.zip_with(chunks, heads, lambda c, at: _before(c, at, lambda x: x["gap"], _both)))


def _starts(matches: Column, gaps: Column) -> Column:
    """The code point at which each match starts: lengths of gaps and matches before it, added up."""
    lengths = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(
        F.length(g).alias("gap"), F.length(m).alias("own")))
    return _before(lengths, F.lit(0), lambda x: x["gap"], _both)


def _spans(text: Column, pattern: str, kind: int, likely: Column) -> Column:
    """Array of (start, kind, end) of all matches; texts without one, nearly all, are only searched once."""
    matches, gaps = _found(text, pattern)
    spans = F.zip_with(_starts(matches, gaps), matches, lambda a, m: F.struct(
        a.alias("start"), F.lit(kind).alias("kind"), (a + F.length(m)).alias("end")))
    return F.when(likely & text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def base_spans(text: Column) -> Column:
    """The spans of the fixed kinds by start, then kind: leftmost, not overlapping within a kind."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    every = _spans(text, ASSIGN, 0, F.lit(True))
    assign = F.transform(F.filter(F.arrays_zip(every.alias("span"), values.alias("value")),
                                  lambda x: F.length(x["value"]) >= LEAST_VALUE), lambda x: x["span"])
    assign = F.when(text.rlike(ASSIGN), assign).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return F.array_sort(F.concat(assign, _spans(text, ACCESS, 1, F.contains(text, F.lit("AKIA"))),
                                 _spans(text, HEX, 2, F.lit(True))))


def _places(token: Column) -> Column:
    """The place in the alphabet of each character of a token of the alphabet."""
    lookup = F.array(*[F.lit(ALPHABET.find(chr(c))) for c in range(128)])
    return F.transform(F.split(token, "(?!^)", F.length(token)), lambda c: F.element_at(lookup, F.ascii(c) + 1))


def _steps(token: Column) -> Column:
    """Array of from * size + to over a token, from the start state (the last) to its last character."""
    size = len(ALPHABET)
    places = _places(token)
    return F.zip_with(F.concat(F.array(F.lit(size)), F.slice(places, F.lit(1), F.size(places) - 1)), places,
                      lambda a, b: a * size + b)


def _ratio(token: Column, ratio: list[float]) -> Column:
    """The log-likelihood ratio of a token: that of its steps, added up."""
    table = F.array(*map(F.lit, ratio))
    return F.aggregate(_steps(token), F.lit(0.0), lambda acc, s: acc + F.element_at(table, s + 1))


def _class(length: Column) -> Column:
    """The index in CLASSES of a length."""
    return sum((F.when(length >= first, 1).otherwise(0) for first in CLASSES[1:]), F.lit(0))


def train(docs: DataFrame) -> Models:
    """The models and the ratios that convict.

    Labelled random: the values of base spans; labelled ordinary: identifiers and words of 4 characters or more outside of
    these that two documents or more hold, so that a secret without a label doesn't teach its own likeness, and all
    numbers. All documents count: by the hash of doc_id (of the text where it is null), half of them teach what is ordinary
    and the other half set the ratios that convict; rows that share a hash count once. A table without secrets leaves the random model even. Tokens are counted before they meet the models; at most
    69 x 68 counts of each model and a histogram of ratios come to the driver.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.xxhash64("doc_id"))
    texts = docs.select(text.alias("text"), key.alias("order"))
    suspect = f"{ASSIGN}|{ACCESS}|{HEX}"

    def tokens(rows: DataFrame, pattern: str) -> DataFrame:
        """(token, count, several): each token, how often it occurs, and whether more than one document holds it."""
        return rows.select("order", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("token")).groupBy(
            "token").agg(F.count("*").alias("count"), (F.min("order") < F.max("order")).alias("several"))

    dirty = texts.where(F.col("text").rlike(suspect)).dropDuplicates(["order"])
    value = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all(
        "text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    plain = texts.dropDuplicates(["order"]).select(
        F.regexp_replace("text", suspect, " ").alias("text"), "order", (F.col("order") % 2 == 0).alias("teaches"))
    secret = dirty.select(F.explode(F.array_distinct(value)).alias("token")).where(F.length("token") >= LEAST_VALUE)
    ordinary = tokens(plain.where("teaches"), IDENTIFIER).where(F.col("several") | F.col("token").rlike("^[0-9-]+$"))
    steps = secret.groupBy("token").count().select("token", "count", F.lit(0).alias("model")).unionByName(
        ordinary.select("token", "count", F.lit(1).alias("model")))
    counts = steps.select("model", "count", F.explode(_steps(F.col("token"))).alias("step")).groupBy("model", "step").agg(
        F.sum("count"))
    size = len(ALPHABET)
    seen = [[0] * (size * (size + 1)) for _ in range(2)]
    for model, step, n in counts.collect():
        seen[model][step] += n
    random, plain_ = map(_logs, seen)
    ratio = [a - b for a, b in zip(random, plain_, strict=True)]
    bucket = F.when(F.col("token").rlike(f"^{PLAIN}"), 0).otherwise(
        F.floor(F.greatest(F.least(_ratio(F.col("token"), ratio), F.lit(MOST_RATIO)), F.lit(0.0)) * FINE))
    held = tokens(plain.where("not teaches"), TOKEN).groupBy(
        _class(F.length("token")).alias("class"), bucket.alias("bucket")).agg(F.sum("count"))
    return Models(ratio, _cuts([tuple(r) for r in held.collect()]))


def _cuts(held: list[tuple[int, int, int]]) -> list[float]:
    """Per class the least ratio that at most FALSE_ALARMS of its ordinary tokens reach, from (class, bucket, count). A class
    with too few tokens to tell takes that of all classes together."""
    def cut(counts: dict[int, int]) -> float:
        allowed, above = FALSE_ALARMS * sum(counts.values()), 0
        for bucket in sorted(counts, reverse=True):
            above += counts[bucket]
            if above > allowed:
                return min(MOST_RATIO, max(LEAST_RATIO, (bucket + 1) / FINE))
        return LEAST_RATIO

    by_class = [{b: n for c, b, n in held if c == k} for k in range(len(CLASSES))]
    together: dict[int, int] = {}
    for counts in by_class:
        for b, n in counts.items():
            together[b] = together.get(b, 0) + n
    return [cut(counts if sum(counts.values()) * FALSE_ALARMS >= 1 else together) for counts in by_class]


def _logs(steps: list[int]) -> list[float]:
    """Logarithms of step probabilities: counts by state, smoothed by PULL of the model's own character frequencies, and
    these by one count per character. So a step from a rare state is as likely as its character is."""
    size = len(ALPHABET)
    total = sum(steps) + size
    often = [(sum(steps[c::size]) + 1) / total for c in range(size)]
    out = []
    for state in range(size + 1):
        row = steps[state * size:(state + 1) * size]
        out += [math.log((n + PULL * often[c]) / (sum(row) + PULL)) for c, n in enumerate(row)]
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind, end) in code points, end exclusive, kind an index of KINDS, in order
    of start and kind; `spans` holds the base spans and the random tokens that overlap none of them.

    Null texts count as empty and have no spans; rows are independent, repeated rows repeat, a null doc_id stays null, and
    extra columns are left out.
    """
    models = train(docs)
    cuts = F.array(*map(F.lit, models.cuts))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    text, empty = F.col("text"), F.array().cast("array<struct<start:int,kind:int,end:int>>")
    matches, gaps = _found(text, JUDGED)
    # One projection for each step, so that no step runs again for every use of its result.
    found = rows.select("doc_id", "text", base_spans(text).alias("base"), matches.alias("tokens"))
    verdicts = F.transform("tokens", lambda m: (_ratio(m, models.ratio) >= F.greatest(
        F.element_at(cuts, _class(F.length(m)) + 1), PER_CHARACTER * F.length(m))))
    judged = found.select("*", verdicts.alias("guilty"))
    some = F.exists("guilty", lambda g: g)
    measured = judged.select("doc_id", "base", "guilty", F.when(some, F.transform("tokens", F.length)).alias("own"), F.when(
        some, F.transform(gaps, F.length)).alias("gaps"))
    lengths = F.zip_with("own", F.slice("gaps", 1, F.size("own")), lambda o, g: F.struct(g.alias("gap"), o.alias("own")))
    placed = measured.select("doc_id", "base", "guilty", "own", F.when(F.col("own").isNotNull(), lengths).alias("lengths"))
    placed = placed.select("doc_id", "base", "guilty", "own", F.when(F.col("own").isNotNull(), _chunks(F.col(
        "lengths"))).alias("chunks"))
    placed = placed.select("doc_id", "base", "guilty", "own", "chunks", F.when(F.col("own").isNotNull(), _heads(F.col(
        "chunks"))).alias("heads"))
    placed = placed.select("doc_id", "base", F.when(F.col("own").isNotNull(), F.arrays_zip(
        "guilty", "own", _inside(F.col("chunks"), F.col("heads")).alias("start"))).alias("all"))
    random = F.transform(F.filter("all", lambda t: t["guilty"]), lambda t: F.struct(
        t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), (t["start"] + t["own"]).alias("end")))
    found = placed.select("doc_id", "base", F.coalesce(random, empty).alias("random"))
    clear = F.filter("random", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", clear)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
