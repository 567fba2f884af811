"""SimHash near-duplicates by BK-trees over shards of fingerprints.

Two 64-bit fingerprints that differ in at most r bits agree in all but r of the blocks that the bits are cut into. Every
distinct fingerprint goes to one shard per choice of r blocks left out, keyed by the bits of the other blocks, so linked
fingerprints meet in a shard and shards stay small. A shard builds a BK-tree (children keyed by their Hamming distance to
the parent) and looks up its fingerprints, following only edges within the radius. Shards beyond TREE fingerprints, which
a cloud of near copies can fill, are cut into several trees, each sent to every part of the shard's fingerprints.

Rows with one fingerprint are one class from the start, so copies are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.slices import written
from riskspark.llm.textblocks import in_batches, runs, words
from riskspark.operators.graph import components
from riskspark.operators.skew import with_groups
from riskspark.session import checkpoint_dir

SEED = 42
#: Fingerprints in one tree.
TREE = 4_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def simhash(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes, repeats included: a bit is set if it is in over half of them; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, print) row by row: `print` is the SimHash, as a signed bigint, of the XXH64 of every `width` words in a
    row (A-Z in lower case, joined by spaces); fewer words are one shingle, no word gives 0. Null counts as empty."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = []
            for run in runs(batch.column("text")):
                found = words(run)
                lengths = found.ends - found.starts
                # The words of the run, one space after each.
                where = np.concatenate([[0], np.cumsum(lengths + 1)])
                flat = np.full(where[-1], 32, np.uint8)
                inside = np.repeat(found.starts - where[:-1], lengths + 1) + np.arange(where[-1])
                letter = np.ones(where[-1], bool)
                letter[where[1:] - 1] = False
                flat[letter] = _LOWER[run.data[inside[letter]]]
                text = flat.tobytes()
                at = where.tolist()
                for a, b in zip(found.before[:-1].tolist(), found.before[1:].tolist(), strict=True):
                    n = min(width, b - a)
                    if not n:
                        out.append(0)
                        continue
                    last = b - n + 1
                    out.append(simhash(np.array([digest(text[x:y - 1], SEED) for x, y in
                                                 zip(at[a:last], at[a + n:b + 1], strict=True)], np.uint64)))
            signed = np.array(out, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed)], ["doc_id", "print"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.transform(in_batches, work, "doc_id bigint, print bigint")


class BKTree:
    """Distinct integers by Hamming distance."""

    def __init__(self, values: list[int]):
        self.root, self.children = values[0], {v: {} for v in values}
        for value in values[1:]:
            node = self.root
            while True:
                distance = (node ^ value).bit_count()
                below = self.children[node]
                if distance not in below:
                    below[distance] = value
                    break
                node = below[distance]

    def near(self, value: int, radius: int) -> list[int]:
        """All members within the radius; only edges that the triangle inequality leaves are followed."""
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            distance = (node ^ value).bit_count()
            if distance <= radius:
                out.append(node)
            for edge, child in self.children[node].items():
                if distance - radius <= edge <= distance + radius:
                    todo.append(child)
        return out


def links(prints: DataFrame, radius: int) -> DataFrame:
    """(src, dst), src < dst, distinct: all pairs of the distinct bigints `print` that differ in 1 to `radius` bits."""
    blocks = radius + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in range(blocks) if k not in out)
             for out in combinations(range(blocks), radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select("print", F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(m)) for m in signed])).alias(
        "mask", "bits"))
    sizes = keyed.groupBy("mask", "bits").agg(F.count("*").alias("n")).where("n > 1").select(
        "mask", "bits", "n", F.ceil(F.col("n") / TREE).cast("int").alias("trees"))
    inside = with_groups(keyed, sizes, ["mask", "bits"], "n")
    part = F.pmod(F.xxhash64("print"), F.col("trees")).cast("int")
    # Cell (part, tree): the fingerprints of a part look up a tree, their own one or a later one.
    members = inside.select("mask", "bits", "print", part.alias("tree"), F.explode(
        F.sequence(F.lit(0), part)).alias("part"), F.lit(False).alias("asks"))
    askers = inside.select("mask", "bits", "print", part.alias("part"), F.explode(
        F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"), F.lit(True).alias("asks")).where("tree > part")
    cells = ["mask", "bits", "part", "tree"]
    stream = members.unionByName(askers).repartition(*cells).sortWithinPartitions(*cells, "asks", "print")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, values, asking = None, [], []

        def pairs() -> list[tuple[int, int]]:
            found = []
            if values and (len(values) > 1 or asking):
                tree = BKTree([v & (1 << 64) - 1 for v in values])
                for v in asking or values:
                    found += [(v, m) for m in tree.near(v & (1 << 64) - 1, radius) if m != v & (1 << 64) - 1]
            return [tuple(sorted((a, m - (1 << 64) if m >> 63 else m))) for a, m in found]

        for batch in batches:
            out = []
            for *key, asks, value in zip(*[batch.column(c).to_pylist() for c in (*cells, "asks", "print")], strict=True):
                if key != cell:
                    out += pairs()
                    cell, values, asking = key, [], []
                (asking if asks else values).append(value)
            yield _pairs(out)
        yield _pairs(pairs())

    return stream.transform(in_batches, work, "src bigint, dst bigint").distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    sources, targets = zip(*sorted(set(found)), strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(sources, pa.int64()), pa.array(targets, pa.int64())], ["src", "dst"])


def near_groups(docs: DataFrame, width: int = 3, radius: int = 2, more: DataFrame | None = None) -> DataFrame:
    """(doc_id, print, component_id) per row: documents are linked if their fingerprints differ in at most `radius` bits,
    and component_id is the smallest doc_id that links lead to, over any number of steps, the own one included. `more`
    has further links, (src, dst) of doc_ids that occur once.

    Null and empty texts have fingerprint 0 and are linked like others. A null doc_id never becomes a component_id while
    its component has another. Repeated rows give repeated rows. Extra columns are left out. Links, components and
    fingerprints stay distributed; a frequent fingerprint or component is joined by a bounded broadcast (`with_groups`).
    """
    checkpoint_dir(docs.sparkSession)
    rows = fingerprints(docs, width).checkpoint()
    classes = rows.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).checkpoint()
    edges = links(classes.select("print"), radius)
    if more is not None:
        ends = [rows.select(F.col("doc_id").alias(f"_{c}"), F.col("print").alias(f"_p_{c}")) for c in ("src", "dst")]
        edges = edges.unionByName(more.join(ends[0], F.col("src") == F.col("_src")).join(
            ends[1], F.col("dst") == F.col("_dst")).select(F.col("_p_src").alias("src"), F.col("_p_dst").alias("dst")))
    found = components(classes.select(F.col("print").alias("node")), edges.checkpoint())
    placed = classes.join(found.withColumnRenamed("node", "print"), "print").checkpoint()
    roots = placed.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("classes"))
    named = with_groups(placed, roots, ["component"], "classes").select("print", "n", "component_id")
    return with_groups(rows, named, ["print"], "n").select("doc_id", "print", "component_id")


def first_rows(docs: DataFrame, width: int = 3, radius: int = 2, more: DataFrame | None = None) -> DataFrame:
    """The rows of `docs`, all columns, that stay: of each component the row with the smallest doc_id. A row without a
    doc_id stays, as it can't be told from others, and so does a repeated doc_id while one of its texts stays."""
    gone = near_groups(docs, width, radius, more).groupBy("doc_id").agg(
        F.bool_and(F.col("doc_id") != F.col("component_id")).alias("gone"))
    dropped = written(gone.where("gone").select(F.col("doc_id").alias("_id")))
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    return rows.join(dropped, F.col("_row.doc_id") == F.col("_id"), "left_anti").select("_row.*")
