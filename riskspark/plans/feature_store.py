"""Stored feature groups: one table per group of features that share their timelines, partitioned by day and key hash.

A day is computed once and read by whatever needs it. A read opens only the tables of the groups that hold the asked
features, only the days of its window and, for given events, only the parts their ids hash to. A day written again
replaces that day alone, so a lost and repeated job leaves the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.constants import FEATURES
from riskspark.operators.snapshots import SHARD, shard_of
from riskspark.plans.features import DIMENSIONS, P95, PREVIOUS, TOTALS
from riskspark.plans.lake import Lake

#: Parts of a day. Fixed when a store is first written.
PARTS = 8
#: Features of running totals, of quantiles, of previous events, of dimensions, and the constant ones.
GROUPS = {"velocity": list(TOTALS), "amounts": list(P95), "previous": PREVIOUS}
GROUPS["static"] = [f for f in FEATURES if f not in sum(GROUPS.values(), [])]
assert set(DIMENSIONS) <= set(GROUPS["static"] + PREVIOUS)


def day_of(time: Column) -> Column:
    """Days since 1970; -1 for rows without a time."""
    return F.coalesce(F.unix_date(F.to_date(time)), F.lit(-1))


def _day(text: str) -> Column:
    return F.unix_date(F.lit(text).cast("date"))


def store(lake: Lake, path: str, start: str | None = None, end: str | None = None, groups: list[str] | None = None,
          parts: int = PARTS) -> None:
    """Writes the features of the events of the days [start, end), or of all, one table per group below `path`. Only the
    timelines of a group are computed for its table; a window bounds what is written, not what the timelines look back on."""
    for group in groups or GROUPS:
        rows = lake.some_features(GROUPS[group]).select(
            "auth_event_id", *GROUPS[group], day_of(F.col("event_time")).alias("day"),
            shard_of("auth_event_id", parts).alias(SHARD))
        if start is not None:
            rows = rows.where((F.col("day") >= _day(start)) & (F.col("day") < _day(end)))
        # Rebalancing cuts days that are too large for one task and leaves small ones in one file per part.
        rows.hint("rebalance", F.col("day"), F.col(SHARD)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "day", SHARD).parquet(f"{path}/{group}")


def read(spark: SparkSession, path: str, names: list[str], start: str | None = None, end: str | None = None,
         requested: DataFrame | None = None, parts: int = PARTS) -> DataFrame:
    """(auth_event_id, names) of the stored events, optionally of the days [start, end) and of the ids in `requested`."""
    asked = None if requested is None else requested.select("auth_event_id").distinct()
    shards = [] if asked is None else [r[0] for r in asked.select(shard_of("auth_event_id", parts)).distinct().collect()]

    def table(group: str) -> DataFrame:
        rows = spark.read.parquet(f"{path}/{group}")
        if start is not None:
            rows = rows.where((F.col("day") >= _day(start)) & (F.col("day") < _day(end)))
        if asked is not None:
            rows = rows.where(F.col(SHARD).isin(shards)).join(asked, "auth_event_id", "left_semi")
        return rows.select("auth_event_id", "day", SHARD, *[n for n in GROUPS[group] if n in names])

    tables = [table(g) for g, held in GROUPS.items() if set(held) & set(names)]
    joined = reduce(lambda a, b: a.join(b, ["auth_event_id", "day", SHARD]), tables)
    return joined.select("auth_event_id", *names)
