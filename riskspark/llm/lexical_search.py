"""Ranked lexical search: the highest-scoring documents of each item, by a K2-treap over the term-document grid.

Only terms of the items matter. One pass over the documents counts them, whole texts, into a table of postings; totals
and document frequencies are Spark aggregates over that table. Each task then builds treaps over shards of its documents
(cells: what a term adds to a document's score) and answers every item best-first, with the scores found in earlier shards
as a floor. What leaves a task is its best documents per item; these are merged in Spark. No postings are shuffled.

Items are served in blocks of a bounded number of terms, so what tasks are sent has a bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.k2_treap import K2Treap
from riskspark.llm.slices import written
from riskspark.llm.textblocks import in_batches, runs, texts_of, word_hashes, words

#: Item terms in a block, with repeats between items; documents and cells in a shard.
BLOCK_TERMS, SHARD_DOCS, SHARD_CELLS = 200_000, 8_192, 1 << 20
#: Parts in which the tasks' answers are merged first.
MERGE = 64
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes that separate terms: all of ASCII but digits and letters.
_SEPARATES = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
POSTINGS = "doc_id bigint, n bigint, terms array<int>, times array<int>"


def terms_of(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.array_distinct(F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(TERM), F.lit(0)))


def _hashes(terms: list[str]) -> np.ndarray:
    """The hash of each term, as `postings` finds it in texts."""
    out = []
    for run in runs(pa.array(terms, pa.large_string())):
        out.append(word_hashes(run, words(run, _SEPARATES), lower=True))
    return np.concatenate([*out, np.zeros(0, np.uint64)])


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, terms, times) row by row: the number of terms in the text, which of `terms` occur, by place in the
    list, and how often. Terms are told by 64-bit hash and length."""
    hashes, lengths = _hashes(terms), np.array([len(t.encode()) for t in terms], np.int64)
    order = np.argsort(hashes)
    ranked = hashes[order]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(texts_of(batch.column("text"))):
                found = words(run, _SEPARATES)
                n = np.diff(found.before)
                h = word_hashes(run, found, lower=True)
                at = np.minimum(np.searchsorted(ranked, h), max(len(ranked) - 1, 0))
                hit = np.flatnonzero(ranked[at] == h) if len(ranked) else np.zeros(0, np.int64)
                term = order[at[hit]] if len(hit) else hit
                same = lengths[term] == (found.ends - found.starts)[hit]
                hit, term = hit[same], term[same]
                row = np.repeat(np.arange(len(n)), n)[hit]
                both, times = np.unique(row * max(len(terms), 1) + term, return_counts=True)
                bounds = pa.array(np.searchsorted(both, np.arange(len(n) + 1) * max(len(terms), 1)), pa.int32())
                listed = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (
                    both % max(len(terms), 1), times)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(run.first, run.last - run.first), pa.array(n.astype(np.int64)), *listed],
                    ["doc_id", "n", "terms", "times"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_batches, work, POSTINGS)


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """What terms weigh that occur in df of the documents."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def impacts(weight: np.ndarray, times: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term adds to the score of a document of n terms in which it occurs `times` times."""
    m = 100 - 90 + 90 * n * documents // max(total, 1)
    return weight * (1_000_000_000 * times // (1000 * times + 8 * m))


def _answers(found: DataFrame, items: list[np.ndarray], weight: np.ndarray, documents: int, total: int, most: int) -> DataFrame:
    """(part, item, doc_id, score): the best of each task."""
    # Rows of the grid by weight, so that terms that can add much share their nodes.
    rank = np.empty(len(weight), np.int64)
    rank[np.argsort(-weight, kind="stable")] = np.arange(len(weight))
    paths = [np.sort(rank[terms[weight[terms] > 0]]) for terms in items]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        best: list[list[tuple[int, bool, int]]] = [[] for _ in items]
        held, docs, cells = [], 0, 0

        def shard() -> None:
            ids = pa.concat_arrays([h[0] for h in held])
            missing, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            n, sizes, terms, times = (np.concatenate([h[k] for h in held]) for k in range(1, 5))
            order = np.lexsort((ids, missing))
            column = np.empty(len(ids), np.int64)
            column[order] = np.arange(len(ids))
            of = np.repeat(np.arange(len(ids)), sizes)
            added = impacts(weight[terms], times.astype(np.int64), n[of], documents, total)
            some = added > 0
            treap = K2Treap(rank[terms[some]], column[of[some]], added[some])
            for k, path in enumerate(paths):
                full = len(best[k]) == most
                new = treap.best(path, most, -best[k][-1][0] if full else 1)
                best[k] = sorted(best[k] + [(-s, bool(missing[order[c]]), int(ids[order[c]])) for s, c in new])[:most]

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                piece = batch.slice(start, 1024)
                listed = [piece.column(c) for c in ("terms", "times")]
                sizes = listed[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                held.append((piece.column("doc_id"), piece.column("n").to_numpy(), sizes,
                             *[x.flatten().to_numpy() for x in listed]))
                docs, cells = docs + piece.num_rows, cells + int(sizes.sum())
                if docs >= SHARD_DOCS or cells >= SHARD_CELLS:
                    shard()
                    held, docs, cells = [], 0, 0
        if held:
            shard()
        rows = [(part, k, None if missing else i, -s) for k, found_ in enumerate(best) for s, missing, i in found_]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(
            (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["part", "item", "doc_id", "score"])

    return found.transform(in_batches, work, "part int, item int, doc_id bigint, score bigint")


def _first(rows: DataFrame, most: int, *by: str | Column) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def ranked(docs: DataFrame, items: DataFrame, most: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `most` documents with the highest score above 0 for each item_id.

    Equal scores are ranked by ascending doc_id, a null one last. A null text has no terms; every row of `docs` is a
    document, repeated ones too. Rows of `items` with one item_id are one item with the terms of all; a null item_id is an
    item too. An item without terms, or whose terms no document has, gives no rows; so do empty tables.
    """
    pairs = items.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    blocks = max(1, -(-pairs.count() // block_terms))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    kind = items.schema["item_id"].dataType
    out = []
    for b in range(blocks):
        asked = pairs.where(block == b).orderBy("item_id", "term").toArrow().to_pylist()  # about block_terms rows
        terms = sorted({r["term"] for r in asked})
        place = {t: k for k, t in enumerate(terms)}
        of: dict = {}
        for r in asked:
            of.setdefault(r["item_id"], []).append(place[r["term"]])
        found = written(postings(docs, terms))
        documents, total = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(terms), np.int64)
        for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row per item term
            df[r.term] = r["count"]
        answers = _answers(found, [np.array(t, np.int64) for t in of.values()], weights(df, documents), documents, total, most)
        near = _first(answers, most, "item", F.pmod("part", F.lit(MERGE)).alias("_")).drop("rank")
        names = docs.sparkSession.createDataFrame(list(zip(range(len(of)), of, strict=True)), f"item int, item_id {kind.simpleString()}")
        out.append(_first(near, most, "item").join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, out)
