"""Exact positions in one global order, for any number of rows and any values.

Rows are dealt out by range of the order, so a partition holds neighbours and equal keys stay together. Each partition is
totalled; the totals of the partitions before it, summed in a window over partitions, are where it starts; inside a
partition a window adds up its own rows. No window holds more than one partition's rows or one row per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskspark.session import checkpoint_dir

BEFORE = (Window.unboundedPreceding, -1)


def running(rows: DataFrame, groups: list[str], order: list[str], measures: list[str]) -> DataFrame:
    """Adds `{m}_before`, the total of each measure over the group's rows before this one, and `{m}_total`, that of all.

    `rows` has one row per (groups, order); aggregate equal rows first, so that a frequent value is one row. Measures are
    whole numbers or decimals. The dealt rows are checkpointed: the range bounds are drawn from a sample, and both passes
    must see the same ones.
    """
    checkpoint_dir(rows.sparkSession)
    placed = rows.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    keys = [F.struct(F.lit(0), *groups).alias("_group"), "_part"]
    totals = placed.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
    ahead = Window.partitionBy("_group").orderBy("_part").rowsBetween(*BEFORE)
    whole = Window.partitionBy("_group")
    starts = totals.select(
        F.col("_group").alias("_start_group"), F.col("_part").alias("_start_part"),
        *[F.coalesce(F.sum(m).over(ahead), F.lit(0)).alias(f"_start_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures])
    inside = Window.partitionBy("_group", "_part").orderBy(*order).rowsBetween(*BEFORE)
    within = placed.select(keys[0], *placed.columns).select("*", *[
        F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_within_{m}") for m in measures])
    joined = within.join(starts, (F.col("_group") == F.col("_start_group")) & (F.col("_part") == F.col("_start_part")))
    return joined.select(*rows.columns, *[(F.col(f"_start_{m}") + F.col(f"_within_{m}")).alias(f"{m}_before") for m in measures],
                         *[f"{m}_total" for m in measures])
