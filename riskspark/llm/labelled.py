"""Bounded samples of labelled documents, and the folds that labels are learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, folds: int) -> Column:
    """CRC-32 of the doc_id as text, modulo `folds`; null for a null doc_id."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def taught(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """(doc_id, label) of the rows that may be learned from: labelled, and not in the held-out fold. Of repeated rows of a
    doc_id the largest label counts."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held)
                        ).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))


def first_by_hash(keys: DataFrame, n: int) -> DataFrame:
    """The n rows whose doc_id has the smallest hash: the same at every run, independent of all else."""
    return keys.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def held_out(folds: int, held: int) -> Column:
    return F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out")
