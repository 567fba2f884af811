"""Quality classifier by positive-unlabelled learning.

Only trusted positives teach; the web text beside them is a mixture of good and bad. With the class prior p, the risk of a
scorer g under the logistic loss l is p * E+[l(g)] + max(0, Eu[l(-g)] - p * E+[l(-g)]): the second term is the risk on
negatives, seen through the unlabelled rows, kept from turning negative, which is how flexible models overfit. The prior
is estimated as the share of positives among the labelled rows of the training folds; negative labels serve nothing else.

Features are shares of character classes and statistics of words and lines, computed for whole texts in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.labelled import first_by_hash, fold, taught
from riskspark.llm.textblocks import in_batches, runs, word_hashes, words

POSITIVES, UNLABELLED = 8_000, 16_000
EPOCHS, RATE, DECAY = 600, 0.05, 1e-3
ACCEPT = 0.7
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]


def features(column: pa.Array) -> np.ndarray:
    """One row of features per text; a text without words has zeros only."""
    out = []
    for run in runs(column):
        docs = len(run.bounds) - 1
        sizes = np.diff(run.bounds)
        doc = np.repeat(np.arange(docs), sizes)
        bytes_ = np.bincount(doc * 256 + run.data, minlength=docs * 256).reshape(docs, 256).astype(float)
        found = words(run)
        counts = np.diff(found.before)
        of = np.repeat(np.arange(docs), counts)
        length = (found.ends - found.starts).astype(float)
        first, last = run.data[found.starts], run.data[found.ends - 1]
        capital = (first >= 65) & (first <= 90)
        marked = np.isin(last, _MARKS)
        upper = np.concatenate([[0], np.cumsum((run.data >= 65) & (run.data <= 90))])
        shouting = (upper[found.ends] - upper[found.starts]) * 2 > length
        hashes = word_hashes(run, found, lower=True)
        order = np.lexsort((hashes, of))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
        total = lambda values, of=of, docs=docs: np.bincount(of, values.astype(float), docs)
        n, size = np.maximum(counts, 1), np.maximum(sizes, 1)[:, None]
        mean = total(length) / n
        lines = bytes_[:, 10] + 1
        shares = np.sqrt(np.column_stack([
            bytes_[:, _MARKS], bytes_[:, 48:58].sum(1), bytes_[:, 65:91].sum(1), bytes_[:, 97:123].sum(1),
            bytes_[:, 128:].sum(1), bytes_[:, :32].sum(1), bytes_[:, 32]]) / size)
        row = np.column_stack([
            shares, np.log1p(sizes), np.log1p(counts), mean, np.sqrt(np.maximum(total(length ** 2) / n - mean ** 2, 0)),
            total(capital) / n, total(marked) / n, total(shouting) / n,
            np.bincount(of[order][new], minlength=docs) / n, np.log1p(counts / lines)])
        row[counts == 0] = 0
        out.append(row)
    return np.concatenate(out) if out else np.zeros((0, len(_MARKS) + 15))


class Model(NamedTuple):
    """A linear scorer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """In (0, 1); the features of a text without words give 0."""
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return np.where(x.any(1), 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Gradient descent (Adam) on the non-negative risk; where the negative part is below zero, its gradient is turned
    around, as the method has it. Without positives or unlabelled rows everything scores the prior."""
    width = positive.shape[1]
    if not len(positive) or not len(unlabelled):
        prior = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(prior / (1 - prior))), prior)
    mean, scale = unlabelled.mean(0), unlabelled.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    p, u = (np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]) for x in (positive, unlabelled))
    w = np.zeros(width + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, EPOCHS + 1):
        zp, zu = p @ w, u @ w
        sp, su = sigmoid(zp), sigmoid(zu)
        right = prior * (p * (sp - 1)[:, None]).mean(0)
        wrong = (u * su[:, None]).mean(0) - prior * (p * sp[:, None]).mean(0)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        slope = (right + wrong if negative >= 0 else -wrong) + DECAY * np.append(w[:-1], 0)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope ** 2
        w = w - RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def train(docs: DataFrame, labels: DataFrame, folds: int, held: int, positives: int = POSITIVES,
          unlabelled: int = UNLABELLED) -> Model:
    """Learns from at most `positives` trusted rows and `unlabelled` others of the training folds, chosen by the hash of
    doc_id, so that the sample is bounded and alike at every size. Only their features come to the driver."""
    known = taught(labels, "quality", folds, held)
    share = known.agg(F.avg("label")).first()[0]
    trusted = first_by_hash(known.where("label = 1").select("doc_id"), positives)
    web = first_by_hash(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(
        fold(F.col("doc_id"), folds) != held), unlabelled)
    chosen = F.broadcast(trusted.select(F.col("doc_id").alias("_id"), F.lit(True).alias("good")).unionByName(
        web.select(F.col("doc_id").alias("_id"), F.lit(False).alias("good"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        chosen, F.col("doc_id") == F.col("_id")).select("doc_id", "good", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), pa.array(
                list(features(batch.column("text"))), pa.list_(pa.float64()))], ["doc_id", "good", "x"])

    sample = rows.transform(in_batches, work, "doc_id bigint, good boolean, x array<double>").orderBy(
        F.xxhash64("doc_id", "x"), "x").limit(positives + unlabelled).toArrow()
    x = sample.column("x").combine_chunks().flatten().to_numpy().reshape(sample.num_rows, features(pa.array([""])).shape[1])
    good = sample.column("good").to_numpy().astype(bool)
    return fit(x[good], x[~good], 0.5 if share is None else float(share))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) row by row; null counts as empty, a text without words scores 0, extra columns are left out."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.score(features(batch.column("text"))))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.transform(in_batches, work, "doc_id bigint, score double")


def accepted(docs: DataFrame, model: Model, least: float = ACCEPT) -> DataFrame:
    """The rows of `docs`, all columns, whose score is at least `least`."""
    schema = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(batch.column("text"))) >= least))

    return docs.transform(in_batches, work, schema)
