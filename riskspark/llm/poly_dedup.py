"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is its length and the values of two polynomials over its bytes, modulo two primes. Texts are hashed
in chunks, all chunks of a run of documents at once; neighbouring chunks combine by shifting the left one by the length
of the right one: H(AB) = H(A) * r ** |B| + H(B). So a huge document costs a few numbers per byte, and pieces hashed
apart give the fingerprint of the whole (`combine`). Equal fingerprints only nominate: the texts of a group are compared
chunk by chunk, as a stream, with the group's first text, and a text that differs leaves the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.textblocks import Run, SPACE, in_batches, runs
from riskspark.operators.skew import with_groups
from riskspark.session import checkpoint_dir

PRIMES = (2147483647, 2147483629)
RADIX = (1103515245, 1664525013)
CHUNK = 4096
COMPARE = 1 << 16
#: Copies that one task compares with its copy of the group's first text.
COPIES = 500
PRINTS = "doc_id bigint, length bigint, h0 bigint, h1 bigint, text_sha256 string"
KEY = ["length", "h0", "h1"]
SPACES = r"[\x20\x09-\x0D]+"
_powers = [np.array([pow(r, k, p) for k in range(CHUNK - 1, -1, -1)], np.uint64)
           for r, p in zip(RADIX, PRIMES, strict=True)]


def normalised(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a run with every stretch of white space inside a document as one space, and the new bounds."""
    space = SPACE[run.data]
    keep = np.ones(len(space), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    begin = run.bounds[:-1][run.bounds[:-1] < run.bounds[1:]]
    keep[begin] = True
    return np.where(space, np.uint8(32), run.data)[keep], np.concatenate([[0], np.cumsum(keep)])[run.bounds]


def fingerprint(data: np.ndarray) -> tuple[int, int, int]:
    """(length, h0, h1) of bytes: chunk hashes in one product per prime, then one fold over the chunks."""
    n = len(data)
    head = n % CHUNK
    rows = data[head:].reshape(-1, CHUNK).astype(np.uint64)
    out = [n]
    for power, prime, radix in zip(_powers, PRIMES, RADIX, strict=True):
        value = int((data[:head].astype(np.uint64) * power[CHUNK - head:]).sum()) % prime if head else 0
        shift = pow(radix, CHUNK, prime)
        for chunk in (rows @ power).tolist():
            value = (value * shift + chunk) % prime
        out.append(value)
    return tuple(out)


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """The fingerprint of two texts in a row from their own."""
    return (left[0] + right[0], *[(a * pow(r, right[0], p) + b) % p for a, b, r, p in
                                  zip(left[1:], right[1:], RADIX, PRIMES, strict=True)])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, length, h0, h1, text_sha256) of every whole normalised text, row by row; null counts as empty."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, digests = [], []
            for run in runs(batch.column("text")):
                data, bounds = normalised(run)
                whole = data.tobytes()
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    found.append(fingerprint(data[a:b]))
                    digests.append(sha256(whole[a:b]).hexdigest())
            parts = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(p, pa.int64()) for p in parts], pa.array(digests, pa.string())],
                ["doc_id", *KEY, "text_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_batches, work, PRINTS)


def _differing(candidates: DataFrame) -> DataFrame:
    """The keys of copies that are not equal to the first text of their group, read beside it as one sorted stream."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first = None, np.zeros(0, np.uint8)
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in (*KEY, "part")], strict=True))
            lead, out, row = batch.column("lead").to_pylist(), set(), 0
            for run in runs(batch.column("text")):
                data, bounds = normalised(run)
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if lead[row] and group != keys[row]:
                        group, first = keys[row], data[a:b].copy()
                    elif group != keys[row]:
                        raise ValueError("a copy came without the first text of its group")
                    elif b - a != len(first) or not all(
                            np.array_equal(data[a + k:min(b, a + k + COMPARE)], first[k:k + COMPARE])
                            for k in range(0, b - a, COMPARE)):
                        out.add(keys[row][:3])
                    row += 1
            columns = list(zip(*sorted(out), strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], KEY)

    return candidates.transform(in_batches, work, "length bigint, h0 bigint, h1 bigint").distinct()


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, length, h0, h1, text_sha256, keep_id, group_size, kept) per row: rows with equal normalised texts are one
    group, its row with the smallest doc_id stays.

    Null and empty texts are equal. A null doc_id counts as larger than any other and stays only where the whole group has
    none. Rows that repeat doc_id and text are marked alike; `first_rows` keeps one of them. Extra columns are left out.
    Groups of any size are spread: fingerprints are counted before the shuffle, a group with a large share of the rows is
    joined by broadcast (`with_groups`), and texts are compared in slices of about COPIES, each with its own copy of the
    first text.
    """
    checkpoint_dir(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = fingerprints(source).checkpoint()
    groups = prints.groupBy(*KEY).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    rows = with_groups(prints, groups, KEY, "group_size").checkpoint()
    differing = _differing(_candidates(source, rows)).checkpoint()
    if not differing.isEmpty():
        # Equal fingerprints of different texts: these groups are formed by the SHA-256 of the texts besides.
        odd = differing.select(*[F.col(c).alias(f"_{c}") for c in KEY], F.lit(True).alias("odd"))
        apart = rows.join(odd, [F.col(c) == F.col(f"_{c}") for c in KEY], "left").select(
            *prints.columns, F.when(F.col("odd"), F.col("text_sha256")).otherwise("").alias("apart")).checkpoint()
        again = apart.groupBy(*KEY, "apart").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        rows = with_groups(apart, again, [*KEY, "apart"], "group_size").drop("apart")
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def _candidates(source: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts of all groups of two or more, dealt out by group and slice, the first text ahead in each slice.

    A doc_id that is repeated with different texts of one length meets each of its fingerprints; at worst that has a
    group formed by SHA-256.
    """
    many = rows.where("group_size > 1")
    none = F.col("doc_id").isNull()
    ids = many.select(
        F.coalesce("doc_id", F.lit(0)).alias("_id"), none.alias("_none"), F.when(none, F.col("text_sha256")).otherwise(
            "").alias("_sha"), *KEY, "keep_id", F.ceil(F.col("group_size") / COPIES).cast("int").alias("parts")).distinct()
    keyed = source.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *_row_key())
    first, spread = F.col("doc_id").eqNullSafe(F.col("keep_id")), F.xxhash64("doc_id")
    if not many.where(none).isEmpty():
        # Rows without doc_id are told apart by their place in the table: the first of a text leads where no row has one.
        keyed = keyed.withColumn("_row", F.monotonically_increasing_id())
        leads = keyed.where("_none").groupBy("_sha").agg(F.min("_row").alias("_lead"))
        ids = ids.join(leads, "_sha", "left")
        first = F.when(F.col("_none"), F.col("keep_id").isNull() & (F.col("_row") == F.col("_lead"))).otherwise(first)
        spread = F.when(F.col("_none"), F.xxhash64("_row")).otherwise(spread)
    length = F.octet_length(F.regexp_replace("text", SPACES, " "))
    texts = keyed.join(ids, ["_id", "_none", "_sha"]).where(length == F.col("length"))
    parts = F.when(first, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(
        F.array(F.pmod(spread, F.col("parts")).cast("int")))
    dealt = texts.select(*KEY, first.alias("lead"), "text", F.explode(parts).alias("part"))
    return dealt.repartition(*KEY, "part").sortWithinPartitions(*KEY, "part", F.desc("lead"))


def _row_key(row: str = "") -> list[Column]:
    """What rows and their groups are joined by: the doc_id, or for rows without one the SHA-256 of the normalised text, so
    that they are not all one key."""
    doc_id, text = F.col(f"{row}doc_id").cast("long"), F.coalesce(F.col(f"{row}text"), F.lit(""))
    return [F.coalesce(doc_id, F.lit(0)).alias("_id"), doc_id.isNull().alias("_none"), F.when(doc_id.isNull(), F.sha2(
        F.regexp_replace(text, SPACES, " ").cast("binary"), 256)).otherwise("").alias("_sha")]


def first_rows(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that stay: one of each group. Among repeated rows of one doc_id and text the one
    stays that is first by the other columns as text."""
    kept = exact_groups(docs).where("kept").select(
        F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.when(
            F.col("doc_id").isNull(), F.col("text_sha256")).otherwise("").alias("_sha"), "text_sha256").distinct()
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    keyed = docs.select(F.struct(*docs.columns).alias("_row")).select("_row", *_row_key("_row."))
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    joined = keyed.join(kept, ["_id", "_none", "_sha"]).where(
        F.sha2(F.regexp_replace(text, SPACES, " ").cast("binary"), 256) == F.col("text_sha256"))
    order = Window.partitionBy("_id", "_none", "text_sha256").orderBy(
        *[F.col("_row")[c].cast("string") for c in others] or [F.lit(1)])
    return joined.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("_row.*")
