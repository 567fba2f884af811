"""Quality rules: learned decision lists over statistics of texts.

Statistics are counted for whole texts in numpy. From labelled rows a list of rules is learned by sequential covering. A
rule is a conjunction of thresholds on shares of these counts. It is grown on two thirds of the rows, condition by
condition by information gain, then pruned on the last third: of its beginnings the one that parts the classes best there
is kept. Rows that a rule covers leave, and the next rule is learned on the others, until a rule is no longer right often
enough. The list becomes one ordered Spark expression, `CASE WHEN ... THEN reject ... ELSE keep`, that can be read and run
anywhere the counts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.labelled import first_by_hash, taught
from riskspark.llm.textblocks import SPACE, Run, Words, chained, in_batches, mixed, runs, word_hashes, words

#: Labelled rows to learn from at most, cuts tried per statistic, rules and conditions at most.
SAMPLE, CUTS, RULES, CONDITIONS = 20_000, 48, 24, 4
#: What share of the rows that a rule covers must be bad, and how many it must cover, on the rows it is pruned on.
PRECISION, COVERS = 0.9, 2
WINDOW = 5
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_DIGITS = np.isin(np.arange(256), list(range(48, 58)))
_MARKS = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_STARTS = (np.arange(256) & 0xC0) != 0x80

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper",
          "n_digits", "n_marks"]
#: The statistics that rules are about: a count over a count.
SHARES = {
    "symbols_per_char": ("n_symbols", "word_chars"), "chars_per_word": ("word_chars", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"), "repeat_words_per_word": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"), "distinct_per_word": ("n_distinct", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"), "digits_per_char": ("n_digits", "word_chars"),
    "marks_per_char": ("n_marks", "word_chars"), "marks_per_word": ("n_marks", "n_words"),
}


def _distinct(doc: np.ndarray, hashes: np.ndarray, docs: int) -> np.ndarray:
    """How many different hashes each document has."""
    keys = np.unique(np.column_stack([doc.astype(np.uint64), hashes]).view([("d", np.uint64), ("h", np.uint64)]).ravel())
    return np.bincount(keys["d"].astype(np.int64), minlength=docs)


def _lines(run: Run, found: Words) -> tuple[np.ndarray, Words]:
    """(document, bounds) of the lines with a word."""
    breaks = np.flatnonzero(run.data == 10)
    starts = np.concatenate([run.bounds[:-1], breaks + 1])
    ends = np.concatenate([breaks, run.bounds[1:]])
    # A break ends its line and starts another; a document that begins where another ends sorts by document.
    doc = np.searchsorted(run.bounds, breaks, side="right") - 1
    documents = np.arange(len(run.bounds) - 1)
    of_start, of_end = np.concatenate([documents, doc]), np.concatenate([doc, documents])
    by_start, by_end = np.lexsort((starts, of_start)), np.lexsort((ends, of_end))
    starts, ends, of = starts[by_start], ends[by_end], of_start[by_start]
    some = np.searchsorted(found.starts, ends) > np.searchsorted(found.starts, starts)
    return of[some], Words(starts[some], ends[some], found.before)


def _repeated(hashes: np.ndarray, found: Words, docs: int) -> np.ndarray:
    """Words per document inside windows of WINDOW words that occur twice or more in it."""
    counts = np.diff(found.before)
    of = np.repeat(np.arange(docs), counts)
    if len(hashes) < WINDOW:
        return np.zeros(docs, np.int64)
    windows = np.flatnonzero(of[:len(of) - WINDOW + 1] == of[WINDOW - 1:])
    key = mixed(chained(hashes, WINDOW)[windows] ^ (of[windows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    ranked = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    twice = windows[order[same[1:] | same[:-1]]]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    return np.bincount(of, np.cumsum(cover)[:-1] > 0, docs).astype(np.int64)


def count(column: pa.Array) -> np.ndarray:
    """(texts, COUNTS): a null text counts as empty."""
    out = []
    for run in runs(column):
        docs = len(run.bounds) - 1
        inside = lambda mask, run=run: np.diff(np.concatenate([[0], np.cumsum(mask)])[run.bounds])
        found = words(run)
        n = np.diff(found.before)
        hashes = word_hashes(run, found, lower=False)
        doc, lines = _lines(run, found)
        n_lines = np.bincount(doc, minlength=docs)
        out.append(np.column_stack([
            n, inside(_STARTS[run.data] & ~SPACE[run.data]), inside(_SYMBOLS[run.data]),
            n_lines - _distinct(doc, word_hashes(run, lines, lower=False), docs), _repeated(hashes, found, docs), n_lines,
            _distinct(np.repeat(np.arange(docs), n), hashes, docs), inside(_UPPER[run.data]), inside(_DIGITS[run.data]),
            inside(_MARKS[run.data])]).astype(np.int64))
    return np.concatenate([*out, np.zeros((0, len(COUNTS)), np.int64)])


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, counts...) row by row over whole texts; other columns are left out, whatever their names."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(np.ascontiguousarray(c)) for c in counts.T]], ["doc_id", *COUNTS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(
        in_batches, work, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))


class Condition(NamedTuple):
    """A statistic is at least (`above`) or below a cut."""

    name: str
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        value = x[:, list(SHARES).index(self.name)]
        return value >= self.cut if self.above else value < self.cut

    def column(self) -> Column:
        over, under = SHARES[self.name]
        value = F.col(over) / F.greatest(F.col(under), F.lit(1))
        return value >= F.lit(self.cut) if self.above else value < F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.cut:.6g}"


class DecisionList(NamedTuple):
    """Rules in order; a text that fits one is rejected, all others are kept."""

    rules: list[list[Condition]]

    def column(self) -> Column:
        """Whether a row with the counts is kept."""
        if not self.rules:
            return F.lit(True)
        tests = [reduce(lambda a, b: a & b, [c.column() for c in rule]) for rule in self.rules]
        first = F.when(tests[0], F.lit(False))
        return reduce(lambda case, test: case.when(test, F.lit(False)), tests[1:], first).otherwise(F.lit(True))

    def keeps(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for rule in self.rules:
            out &= ~np.logical_and.reduce([c.holds(x) for c in rule])
        return out

    def __str__(self) -> str:
        return "\n".join(["if " + " and ".join(map(str, rule)) + ": reject" for rule in self.rules] + ["else: keep"])


def shares(counts: np.ndarray) -> np.ndarray:
    return np.column_stack([counts[:, COUNTS.index(a)] / np.maximum(counts[:, COUNTS.index(b)], 1)
                            for a, b in SHARES.values()]).astype(float)


def _grow(x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """Adds the condition of the highest gain (bad rows left, times the rise of their log share) until all rows left are
    bad or none gains."""
    rule, left = [], np.ones(len(x), bool)
    while len(rule) < CONDITIONS:
        p, n = (left & bad).sum(), (left & ~bad).sum()
        if not n or not p:
            break
        best, gain = None, 1e-9
        for k, name in enumerate(SHARES):
            ranked = np.argsort(x[left, k], kind="stable")
            value, good = x[left, k][ranked], np.cumsum(bad[left][ranked])
            # Cuts half-way between neighbours, at even ranks.
            at = np.unique(np.linspace(1, len(value) - 1, CUTS).astype(int)) if len(value) > 1 else np.zeros(0, int)
            at = at[value[at] > value[at - 1]]
            for above in (False, True):
                p1 = good[-1] - good[at - 1] if above else good[at - 1]
                all1 = len(value) - at if above else at
                gains = p1 * (np.log2(np.maximum(p1, 1e-9) / all1) - np.log2(p / (p + n)))
                if len(gains) and gains.max() > gain:
                    i = at[gains.argmax()]
                    best, gain = Condition(name, above, float((value[i - 1] + value[i]) / 2)), gains.max()
        if best is None:
            break
        rule.append(best)
        left &= best.holds(x)
    return rule


def _prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray) -> tuple[list[Condition], float, int]:
    """(the beginning of the rule that parts these rows best, the share of bad rows it covers, how many it covers)."""
    best, worth, right, covered = rule, -2.0, 0.0, 0
    for size in range(1, len(rule) + 1):
        hit = np.logical_and.reduce([c.holds(x) for c in rule[:size]])
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p + n and (p - n) / (p + n) > worth:
            best, worth, right, covered = rule[:size], (p - n) / (p + n), p / (p + n), p + n
    return best, right, covered


def learn(counts: np.ndarray, bad: np.ndarray, precision: float = PRECISION) -> DecisionList:
    """A list for rows in an order that says nothing about them: every third one is for pruning."""
    x, bad, rules = shares(counts), bad.astype(bool), []
    while len(rules) < RULES and bad.any() and not bad.all():
        last = (np.arange(len(x)) + len(rules)) % 3 == 2
        rule = _grow(x[~last], bad[~last])
        if not rule:
            break
        rule, right, covered = _prune(rule, x[last], bad[last])
        if right < precision or covered < COVERS:
            break
        hit = np.logical_and.reduce([c.holds(x) for c in rule])
        rules.append(rule)
        x, bad = x[~hit], bad[~hit]
    return DecisionList(rules)


def train(docs: DataFrame, labels: DataFrame, folds: int, held: int, sample: int = SAMPLE) -> DecisionList:
    """Learns from at most `sample` labelled rows of the training folds, chosen by the hash of doc_id; only their counts
    come to the driver. Without labels of both kinds the list is empty and keeps everything."""
    known = taught(labels, "quality", folds, held)
    chosen = first_by_hash(known.select("doc_id"), sample).join(known, "doc_id")
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("_id"), F.col("label").alias("_label")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, F.col("doc_id") == F.col("_id"))
    counted = statistics(rows).join(chosen, F.col("doc_id") == F.col("_id")).orderBy(
        F.xxhash64("doc_id", *COUNTS), "doc_id").limit(sample).select("_label", *COUNTS).toArrow()
    counts = np.column_stack([counted.column(c).to_numpy() for c in COUNTS]).reshape(-1, len(COUNTS))
    return learn(counts, counted.column("_label").to_numpy() == 0)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Per row doc_id, the counts, base_failed and kept. Texts without words fail the base; a null text is empty. Equal
    texts are judged alike; a null doc_id stays null."""
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.column())
