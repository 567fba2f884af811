"""Snapshot merges and latest-row selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], first: bool = False) -> DataFrame:
    """One row per key: the columns of the row that is last (or first) in `order`. Combines before the shuffle, so a
    key with very many rows costs one row per input partition."""
    position = F.struct(*order)
    picked = (F.min_by if first else F.max_by)(F.struct(*columns), position).alias("_picked")
    return rows.groupBy(*keys).agg(picked).select(*keys, "_picked.*")


def merge_snapshot(
    current: DataFrame, updates: DataFrame, key: str, update_only: list[str], defaults: dict[str, Column]
) -> DataFrame:
    """Insert unknown keys, change only `update_only` of known ones. `updates` has at most one row per key."""
    new = updates.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in updates.columns if c != key])
    joined = current.join(new, current[key] == F.col("_key"), "full_outer")
    out = [F.coalesce(F.col(key), F.col("_key")).alias(key)]
    for column in current.columns:
        if column == key:
            continue
        arrived = F.col(f"_{column}") if f"_{column}" in new.columns else defaults.get(column, F.lit(None))
        if column in update_only:
            value = F.when(F.col("_key").isNotNull(), arrived).otherwise(F.col(column))
        else:
            value = F.when(F.col(key).isNull(), arrived).otherwise(F.col(column))
        out.append(value.cast(current.schema[column].dataType).alias(column))
    return joined.select(*out)
