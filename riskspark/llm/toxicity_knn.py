"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words (A-Z in lower case, punctuation around them cut off) whose presence in labelled texts depends on the label;
the likelihood-ratio test is strict enough that by chance one term in twenty runs passes. Every labelled text of the
training folds is an example and every term that passes counts; only the terms, 16 bytes each, go to every task. Examples are
vectors over these terms, and equal vectors are one row with their number and the first of their members, as many as an
answer can hold. Blocks of asked vectors meet blocks of examples by key; each meeting builds an index that holds per term its
examples in order with their weights, and per term and stretch of examples the largest weight. A query adds up these maxima
to bounds, visits stretches from the highest bound, and stops once the bound of the next is below its k-th best similarity;
the best of all blocks are exact. Votes weigh by distance, and a logistic curve fitted on votes for the examples themselves,
each left out of its own, makes them probabilities. The neighbours are the evidence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskspark.llm.labelled import taught
from riskspark.llm.textblocks import Words, in_batches, runs, word_hashes, words
from riskspark.session import checkpoint_dir

NEIGHBOURS, BLOCK = 15, 64
#: Blocks that a query visits one by one; if more are left then, their postings are read in one go.
SINGLE = 2
#: Neighbours that are looked for: an example is left out of its own.
LISTED = NEIGHBOURS + 1
#: About how many vectors one meeting has of either side.
ASKED_ROWS, EXAMPLE_ROWS = 16_384, 8_192
#: Steps of the histogram of votes that the curve is fitted on.
BINS = 10_000
LEAST_EXAMPLES = 3
#: Labels that are sent to every task; more are joined.
SENT_LABELS = 1 << 20
_MARK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text the hashes of its distinct terms, sorted, and how often each occurs."""
    for run in runs(column):
        found = words(run)
        starts, ends = found.starts.copy(), found.ends.copy()
        for _ in range(64):
            cut = starts < ends
            cut[cut] = _MARK[run.data[starts[cut]]]
            if not cut.any():
                break
            starts[cut] += 1
        for _ in range(64):
            cut = starts < ends
            cut[cut] = _MARK[run.data[ends[cut] - 1]]
            if not cut.any():
                break
            ends[cut] -= 1
        hashes = word_hashes(run, Words(starts, ends, found.before), lower=True)
        for a, b in zip(found.before[:-1], found.before[1:], strict=True):
            some = hashes[a:b][starts[a:b] < ends[a:b]]
            yield np.unique(some, return_counts=True)


class Index(NamedTuple):
    """Vectors of examples. `hashes` are the terms, sorted; `starts[t, b]` is where the postings of term t begin in block b;
    `order` names for each place the example that stands there."""

    hashes: np.ndarray
    idf: np.ndarray
    starts: np.ndarray
    examples: np.ndarray
    weights: np.ndarray
    maxima: np.ndarray
    order: np.ndarray

    def vector(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of a text: TF-IDF over the known terms, of length 1."""
        return weighed(self.hashes, self.idf, hashes, counts)

    def nearest(self, t: np.ndarray, w: np.ndarray, most: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """(places, similarities) of the `most` most similar examples; only those that share a term. Where the last
        ones are tied, blocks with higher bounds, then lower places, come first."""
        bounds = w @ self.maxima[t]
        found, similar = np.zeros(0, int), np.zeros(0)
        order = np.argsort(-bounds, kind="stable")
        for visited, b in enumerate(order):
            least = max(similar[-1] + 1e-9, 0.0) if len(similar) == most else 0.0
            if bounds[b] <= least:
                break
            if visited >= SINGLE:
                total = np.zeros(len(order) * BLOCK)
                for term, weight in zip(t, w, strict=True):
                    here = slice(self.starts[term, 0], self.starts[term, -1])
                    total[self.examples[here]] += weight * self.weights[here]
                for seen in order[:visited]:
                    total[seen * BLOCK:(seen + 1) * BLOCK] = 0.0
                own = np.flatnonzero(total > least)
                if len(own) > most:
                    last = np.partition(total[own], -most)[-most]
                    own = own[total[own] >= last - 1e-9]
                found, similar = np.append(found, own), np.append(similar, total[own])
                best = np.lexsort((found, -np.round(similar, 9)))[:most]
                return found[best], similar[best]
            total = np.zeros(BLOCK)
            for term, weight in zip(t, w, strict=True):
                here = slice(self.starts[term, b], self.starts[term, b + 1])
                total[self.examples[here] - b * BLOCK] += weight * self.weights[here]
            own = np.flatnonzero(total > 0)
            found, similar = np.append(found, own + b * BLOCK), np.append(similar, total[own])
            best = np.lexsort((found, -np.round(similar, 9)))[:most]
            found, similar = found[best], similar[best]
        return found, similar


def weighed(names: np.ndarray, idf: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in `names`, which are sorted, and weights) of the known ones of these terms, as a vector of length 1."""
    t, c = known(names, hashes, counts)
    return t, weights(idf[t], c)


def known(names: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the sorted `names`, counts) of the terms that are among them."""
    at = np.searchsorted(names, hashes)
    here = at < len(names)
    here[here] = names[at[here]] == hashes[here]
    return at[here], counts[here]


def weights(idf: np.ndarray, counts: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * idf
    return w / np.linalg.norm(w) if len(w) else w


def indexed(hashes: np.ndarray, idf: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]) -> Index:
    """The index of examples with these (places of terms, weights). Like examples stand together, which makes the maxima of
    blocks tight."""
    n = len(vectors)
    lead = [(int(t[np.argmax(w)]), -float(w.max())) if len(t) else (len(hashes), 0.0) for t, w in vectors]
    order = np.array(sorted(range(n), key=lambda i: (*lead[i], i)), int)
    size = np.array([len(vectors[i][0]) for i in order], int)
    example = np.repeat(np.arange(n), size)
    term = np.concatenate([np.zeros(0, int), *[vectors[i][0] for i in order]]).astype(int)
    weight = np.concatenate([np.zeros(0), *[vectors[i][1] for i in order]])
    by = np.lexsort((example, term))
    term, example, weight = term[by], example[by], weight[by]
    blocks = -(-n // BLOCK)
    bounds = np.searchsorted(term * blocks + example // BLOCK, np.arange(len(hashes) * blocks + 1))
    at = np.arange(len(hashes))[:, None] * blocks + np.arange(blocks + 1)
    maxima = np.zeros((len(hashes), blocks))
    np.maximum.at(maxima, (term, example // BLOCK), weight)
    return Index(hashes, idf, bounds[at] if len(hashes) else np.zeros((0, blocks + 1), int), example, weight, maxima, order)


def threshold(tested: int, chance: float = 0.05) -> float:
    """The likelihood ratio (chi squared, one degree of freedom) that none of so many tests passes by chance but with the
    given probability."""
    low, high = 0.0, 200.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if math.erfc(math.sqrt(middle / 2)) > chance / max(tested, 1) else (low, middle)
    return high


def _dependent(pairs: DataFrame, n: int, toxic: int) -> DataFrame:
    """(term, df): the terms whose presence depends on the label."""
    df, of = F.col("df").cast("double"), F.col("toxic").cast("double")
    cell = lambda seen, all_, rate: F.when(seen > 0, seen * F.log(seen / (all_ * rate))).otherwise(0.0)
    rate, n_, t = toxic / n, F.lit(float(n)), F.lit(float(toxic))
    ratio = 2 * (cell(of, df, F.lit(rate)) + cell(df - of, df, F.lit(1 - rate))
                 + cell(t - of, n_ - df, F.lit(rate)) + cell(n_ - t - df + of, n_ - df, F.lit(1 - rate)))
    counted = pairs.groupBy("term").agg(F.count("*").alias("df"), F.sum("label").alias("toxic")).where(
        F.col("df") >= LEAST_EXAMPLES).select("term", "df", ratio.alias("ratio")).checkpoint()
    return counted.where(F.col("ratio") > threshold(counted.count())).select("term", "df")


class Model(NamedTuple):
    """The terms, sorted, and their weights; the examples: (id, terms, counts, n, toxic, members) per distinct vector, and how
    many there are; the curve; the rate of examples without evidence."""

    hashes: np.ndarray
    idf: np.ndarray
    examples: DataFrame | None
    size: int
    slope: float
    offset: float
    plain: float


#: Places of the known terms among the terms of the model, and how often each occurs.
VECTOR = "terms array<int>, counts array<int>"


def train(docs: DataFrame, labels: DataFrame, folds: int, held: int) -> Model:
    """The model of all labelled rows of the training folds; a text counts once. Terms are counted in Spark; the driver gets
    those that pass the test and a histogram of votes."""
    checkpoint_dir(docs.sparkSession)
    chosen = taught(labels, "toxic", folds, held).select(F.col("doc_id").alias("_id"), "label").checkpoint()
    chosen = F.broadcast(chosen) if chosen.count() <= SENT_LABELS else chosen
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(
        chosen, F.col("doc_id") == F.col("_id")).groupBy(F.xxhash64("text").alias("print")).agg(
        F.min_by(F.struct("doc_id", "label", "text"), "doc_id").alias("row")).select("row.*")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(terms(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"),
                 pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())),
                 pa.array([c for _, c in found], pa.list_(pa.int32()))], ["doc_id", "label", "terms", "counts"])

    texts = sample.transform(in_batches, counted, "doc_id bigint, label int, terms array<bigint>, counts array<int>").checkpoint()
    n, toxic = texts.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), None, 0, 0.0, 0.0, toxic / n if n else 0.0)
    if toxic in (0, n):
        return nothing
    passed = _dependent(texts.select("label", F.explode("terms").alias("term")), n, toxic).toArrow()
    names = passed.column("term").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(names)
    names, idf = names[order], np.log((1 + n) / (1 + passed.column("df").to_numpy()[order])) + 1

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True)
            found = [known(names, np.array(t, np.int64).view(np.uint64), np.array(c, np.int32)) for t, c in pairs]
            yield _vectors(batch, ["doc_id", "label"], found)

    each = texts.transform(in_batches, shortened, f"doc_id bigint, label int, {VECTOR}").where(F.size("terms") > 0).checkpoint()
    first = Window.partitionBy("terms", "counts").orderBy("doc_id")
    members = each.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= LISTED).groupBy("terms", "counts").agg(
        F.sort_array(F.collect_list(F.struct("doc_id", "label"))).alias("members"))
    examples = each.groupBy("terms", "counts").agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).join(
        members, ["terms", "counts"]).select(F.monotonically_increasing_id().alias("id"), "*").checkpoint()
    size = examples.count()
    if not size:
        return nothing._replace(hashes=names, idf=idf)
    votes = _left_out(examples, neighbours(examples, size, examples, size, idf))
    spoken = votes.where(F.col("vote").isNotNull()).toArrow()
    vote, seen, bad = (spoken.column(c).to_numpy().astype(float) for c in ("vote", "n", "toxic"))
    slope, offset = _curve(np.concatenate([vote, vote]), np.repeat([1.0, 0.0], len(vote)), np.concatenate([bad, seen - bad]))
    return Model(names, idf, examples, size, slope, offset,
                 (toxic - bad.sum() + toxic / n) / (n - seen.sum() + 1))


def build(names: np.ndarray, df: np.ndarray, occurrences: list[tuple[int, int, int]], ids: np.ndarray, y: np.ndarray,
          rate: float) -> Index:
    """The index of examples `ids` from (doc_id, term, count)."""
    order = np.argsort(names.view(np.uint64))
    hashes = names.view(np.uint64)[order]
    idf = np.log((1 + len(ids)) / (1 + df[order])) + 1 if len(names) else np.zeros(0)
    found: dict[int, tuple[list, list]] = {}
    for doc, term, count in occurrences:
        t, c = found.setdefault(doc, ([], []))
        t.append(term)
        c.append(count)
    return indexed(hashes, idf, [weighed(hashes, idf, np.array(t, np.int64).view(np.uint64), np.array(c, int))
                                 for t, c in (found.get(int(i), ([], [])) for i in ids)])


def _vectors(batch: pa.RecordBatch, kept: list[str], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The kept columns with a vector per row."""
    lists = [pa.array([v[k].astype(np.int32) for v in found], pa.list_(pa.int32())) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *lists], [*kept, "terms", "counts"])


def _pairs(terms: pa.ChunkedArray, counts: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for t, c in zip(terms.to_pylist(), counts.to_pylist(), strict=True):
        yield np.array(t, int), np.array(c, int)


def _search(asked: pa.Table, stored: pa.Table, idf: np.ndarray) -> pa.Table:
    """The best members of one block of examples for one block of asked vectors; a block may be empty."""
    types = pa.schema([("id", pa.int64()), ("found", pa.list_(pa.struct(
        [("unlike", pa.float64()), ("doc_id", pa.int64()), ("label", pa.int32())])))])
    if not asked.num_rows or not stored.num_rows:
        return types.empty_table()
    vectors = list(_pairs(stored.column("terms"), stored.column("counts")))
    names = np.unique(np.concatenate([t for t, _ in vectors]))
    index = indexed(names, idf[names], [(np.searchsorted(names, t), weights(idf[t], c)) for t, c in vectors])
    members = stored.column("members").combine_chunks()
    begin = members.offsets.to_numpy()
    ids, labels = (members.values.field(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "label"))
    rows, found = [], []
    for row, (t, c) in enumerate(_pairs(asked.column("a_terms"), asked.column("a_counts"))):
        # Terms that no example of the block has add nothing.
        places, similar = index.nearest(*known(names, t, weights(idf[t], c)), LISTED)
        if not len(places):
            continue
        own = index.order[places]
        size = begin[own + 1] - begin[own]
        of = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        likeness = np.repeat(similar, size)
        best = np.lexsort((ids[of], -np.round(likeness, 9)))[:LISTED]
        rows.append(row)
        found.append((likeness[best], of[best]))
    bounds = np.cumsum([0, *[len(x) for x, _ in found]]).astype(np.int32)
    similar = np.concatenate([np.zeros(0), *[x for x, _ in found]])
    of = np.concatenate([np.zeros(0, int), *[x for _, x in found]])
    fields = list(types.field("found").type.value_type)
    flat = [pa.array(x, f.type) for x, f in zip((-np.round(similar, 9), ids[of], labels[of]), fields, strict=True)]
    return pa.table([asked.column("a_id").take(pa.array(rows, pa.int64())),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(flat, fields=fields))], schema=types)


def neighbours(asked: DataFrame, number: int, examples: DataFrame, size: int, idf: np.ndarray) -> DataFrame:
    """(id, found) of each of the `number` distinct vectors asked that has any: the LISTED most similar examples as
    (unlike, doc_id, label), equal ones by doc_id; `unlike` is the similarity below zero, to nine places. Every block of asked
    vectors meets every block of examples."""
    blocks, stored = -(-number // ASKED_ROWS), -(-size // EXAMPLE_ROWS)
    part = lambda n: F.pmod(F.xxhash64("terms", "counts"), F.lit(max(n, 1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    # Examples may be asked about themselves: their columns get other names on one side.
    left = asked.select(*[F.col(c).alias(f"a_{c}") for c in ("id", "terms", "counts")], part(blocks).alias("_asked"),
                        every(stored).alias("_block"))
    right = examples.select("terms", "counts", "members", part(stored).alias("_block"), every(blocks).alias("_asked"))
    near = left.groupBy("_asked", "_block").cogroup(right.groupBy("_asked", "_block")).applyInArrow(
        lambda a, b: _search(a, b, idf), "id bigint, found array<struct<unlike: double, doc_id: bigint, label: int>>")
    best = F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, LISTED)
    return near.groupBy("id").agg(best.alias("found"))


def _vote(found: Column) -> Column:
    """The share of toxic ones among the first NEIGHBOURS, closer ones weighing more; null without any."""
    near = F.transform(F.slice(found, 1, NEIGHBOURS), lambda x: F.struct(
        (1 / (F.lit(1.1) - F.least(-x["unlike"], F.lit(1.0)))).alias("w"), x["label"].alias("y")))
    total = F.aggregate(near, F.lit(0.0), lambda s, x: s + x["w"])
    return F.when(F.size(found) > 0, F.aggregate(near, F.lit(0.0), lambda s, x: s + x["w"] * x["y"]) / total)


def _left_out(examples: DataFrame, found: DataFrame) -> DataFrame:
    """(vote, n, toxic): the histogram of votes for examples, each left out of its own. Members beyond the listed ones have
    LISTED others at similarity 1, so they lose nothing by the rest of their vector."""
    rows = examples.join(found, "id")
    listed = rows.select("found", F.explode("members").alias("m")).select(
        _vote(F.filter("found", lambda x: x["doc_id"] != F.col("m.doc_id"))).alias("vote"), F.lit(1).cast("long").alias("n"),
        F.col("m.label").cast("long").alias("toxic"))
    shown = F.aggregate("members", F.lit(0).cast("long"), lambda s, m: s + m["label"])
    others = rows.where(F.col("n") > F.size("members")).select(
        _vote(F.col("found")).alias("vote"), (F.col("n") - F.size("members")).alias("n"), (F.col("toxic") - shown).alias("toxic"))
    return listed.unionByName(others).groupBy((F.round(F.col("vote") * BINS) / BINS).alias("vote")).agg(
        F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def _curve(votes: np.ndarray, truth: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """The logistic curve of a vote by Newton steps, kept finite by a weak pull towards (4, -2)."""
    w, pull = np.array([4.0, -2.0]), 0.1
    if not len(votes):
        return float(w[0]), float(w[1])
    x = np.column_stack([votes, np.ones(len(votes))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ ((p - truth) * times) + pull * (w - [4.0, -2.0])
        step = np.linalg.solve((x * (p * (1 - p) * times)[:, None]).T @ x + pull * np.eye(2), slope)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, evidence) row by row: evidence lists the doc_ids of the nearest labelled examples, nearest first.

    A null, empty or unknown text has no evidence and scores as examples without a known term do. Repeated rows repeat;
    extra columns are left out. Each distinct vector is asked once.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [known(names, h, c) for h, c in terms(batch.column("text"))]
            yield _vectors(batch, ["doc_id"], found)

    checkpoint_dir(docs.sparkSession)
    names = model.hashes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    unknown = F.lit(model.plain).alias("score"), F.array().cast("array<bigint>").alias("evidence")
    if model.examples is None:
        return rows.select("doc_id", *unknown)
    vectors = rows.transform(in_batches, work, f"doc_id bigint, {VECTOR}").checkpoint()
    asked = vectors.where(F.size("terms") > 0).select("terms", "counts").distinct().select(
        F.monotonically_increasing_id().alias("id"), "*").checkpoint()
    chance = 1 / (1 + F.exp(-(F.lit(model.slope) * _vote(F.col("found")) + F.lit(model.offset))))
    answers = neighbours(asked, asked.count(), model.examples, model.size, model.idf).select(
        "id", chance.alias("_score"), F.transform(F.slice("found", 1, NEIGHBOURS), lambda x: x["doc_id"]).alias("_evidence"))
    spoken = vectors.where(F.size("terms") > 0).join(asked.join(answers, "id"), ["terms", "counts"], "left").select(
        "doc_id", F.coalesce("_score", unknown[0]).alias("score"), F.coalesce("_evidence", unknown[1]).alias("evidence"))
    return vectors.where(F.size("terms") == 0).select("doc_id", *unknown).unionByName(spoken)
