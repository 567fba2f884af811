"""Stored snapshots, partitioned by key hash, that a merge rewrites only where it changes something."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.sources import sinks

#: Parts of a snapshot. Fixed when it is first written; a merge reads and writes whole parts.
SHARDS = 64
SHARD = "shard"


def shard_of(key: str, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(shards)).cast("int")


def write(rows: DataFrame, path: str, key: str, shards: int = SHARDS) -> None:
    """A new snapshot: one row per key, dealt out by its hash."""
    rows.withColumn(SHARD, shard_of(key, shards)).repartition(SHARD).write.partitionBy(SHARD).parquet(path)


def read(spark: SparkSession, path: str, keys: DataFrame | None = None, key: str | None = None,
         shards: int = SHARDS) -> DataFrame:
    """The snapshot, or only the parts that hold `keys` (rows with the column `key`)."""
    rows = spark.read.parquet(path)
    if keys is None:
        return rows
    touched = [r[0] for r in keys.select(shard_of(key, shards)).distinct().collect()]  # at most `shards` numbers
    return rows.where(F.col(SHARD).isin(touched)).join(keys.select(key).distinct(), key, "left_semi")


def merge(path: str, updates: DataFrame, key: str, combine: Callable[[DataFrame, DataFrame], DataFrame],
          shards: int = SHARDS) -> list[int]:
    """Replaces the parts of the snapshot at `path` that hold keys of `updates` by `combine(stored rows, updates)`, and
    returns their numbers. `updates` has one row per key; rows of null keys are left out.

    Parts that no update touches keep their files. New parts are written beside the old ones and put in their place when
    all tasks are done, so a lost executor changes nothing, and a merge that is repeated gives the same rows.
    """
    spark = updates.sparkSession
    placed = updates.where(F.col(key).isNotNull()).withColumn(SHARD, shard_of(key, shards))
    touched = sorted(r[0] for r in placed.select(SHARD).distinct().collect())  # at most `shards` numbers
    if not touched:
        return []
    if not sinks.exists(spark, path):
        raise FileNotFoundError(path)
    stored = spark.read.parquet(path)
    columns = stored.columns
    merged = combine(stored.where(F.col(SHARD).isin(touched)).drop(SHARD), placed.drop(SHARD))
    merged.withColumn(SHARD, shard_of(key, shards)).select(*columns).repartition(SHARD).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(SHARD).parquet(path)
    return touched
