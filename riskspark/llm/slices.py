"""Ranks and running totals over groups of any size, in slices, so that no group has to fit into one task."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.operators.skew import with_groups
from riskspark.session import checkpoint_dir

def written(rows: DataFrame) -> DataFrame:
    """The rows from a table written to the shared folder. Unlike a checkpoint's its size is known to the planner, so a
    join with it is a broadcast only if it is small enough for Spark's own limit."""
    path = f"{checkpoint_dir(rows.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


#: Rows of a group that one task sorts at a time, about.
SLICE_ROWS = 20_000


def running(rows: DataFrame, group: list[str], place: str, order: list[str], amounts: dict[str, Column],
            per_slice: int = SLICE_ROWS) -> DataFrame:
    """Adds to each row, per name in `amounts`, the total of that amount over the rows before it in its group.

    `place` is a column in [0, 1) that orders the rows first, `order` breaks its ties; the result is exact for any
    values, and the slices are even if `place` is spread evenly. A group of n rows is cut into n / per_slice slices;
    slices are totalled (combined before the shuffle), their totals are added up in a window over slices, which are few,
    and only inside a slice the rows are sorted. Nulls in `group` form a group of their own.
    """
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_k{i}") for i, c in enumerate(group)]
    keys += [F.col(c).isNull().alias(f"_n{i}") for i, c in enumerate(group)] or [F.lit(0).alias("_all_rows")]
    names = [f"_{x}{i}" for x in "kn" for i in range(len(group))] or ["_all_rows"]
    placed = rows.select("*", *keys, *[a.cast("long").alias(f"_a{i}") for i, a in enumerate(amounts.values())])
    sizes = placed.groupBy(*names).agg(F.count("*").alias("_rows"))
    sizes = sizes.withColumn("_slices", F.ceil(F.col("_rows") / per_slice))
    cut = with_groups(placed, sizes, names, "_rows").withColumn(
        "_slice", F.least(F.floor(F.col(place) * F.col("_slices")), F.col("_slices") - 1).cast("long"))
    totals = cut.groupBy(*names, "_slice").agg(
        *[F.sum(f"_a{i}").alias(f"_t{i}") for i in range(len(amounts))])
    ahead = Window.partitionBy(*names).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*names, "_slice", *[
        F.coalesce(F.sum(f"_t{i}").over(ahead), F.lit(0)).alias(f"_s{i}") for i in range(len(amounts))])
    inside = Window.partitionBy(*names, "_slice").orderBy(place, *order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(starts, [*names, "_slice"]).select(*rows.columns, *[
        (F.col(f"_s{i}") + F.coalesce(F.sum(f"_a{i}").over(inside), F.lit(0))).alias(name)
        for i, name in enumerate(amounts)])
    return out
