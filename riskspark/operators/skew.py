"""A join that no frequent key can hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than a HOT_SHARE-th of all rows are joined by broadcast: there can't be more than HOT_SHARE of them.
HOT_SHARE = 2_000


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str,
                hot_share: int = HOT_SHARE) -> DataFrame:
    """Inner join of rows with one row per key of `groups` (keys without nulls), for keys of any frequency. The column
    `count` of `groups` is the number of rows with that key.

    Keys with more than one row in `hot_share` are at most `hot_share` many; they go out as a broadcast of that bound.
    Every other key has few rows, so a shuffle spreads them evenly; rows of hot keys are dealt out by a hash of their
    values instead of their key, and find their group in the broadcast.
    """
    added = [c for c in groups.columns if c not in keys]
    total = groups.agg(F.sum(count).alias("_all"))
    hot = groups.join(F.broadcast(total), F.col(count) * hot_share > F.col("_all")).select(
        *[F.col(k).alias(f"_h_{k}") for k in keys], F.struct(F.lit(1).alias("_"), *added).alias("_hot"))
    spread = F.when(F.col("_hot").isNotNull(), F.xxhash64(*rows.columns)).otherwise(F.lit(0))
    marked = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"_h_{k}") for k in keys], "left").select(
        *rows.columns, "_hot", spread.alias("_spread"))
    cold = groups.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.lit(0).cast("long").alias("_c_spread"),
                         F.struct(F.lit(1).alias("_"), *added).alias("_cold"))
    joined = marked.join(cold, [*[F.col(k) == F.col(f"_c_{k}") for k in keys], F.col("_spread") == F.col("_c_spread")],
                         "left")
    return joined.where(F.col("_hot").isNotNull() | F.col("_cold").isNotNull()).select(
        *rows.columns, *[F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in added])
