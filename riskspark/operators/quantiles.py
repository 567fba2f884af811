"""Exact quantiles of one column over any number of rows, without collecting its values into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskspark.operators.ranges import sliced_totals


def ranked_values(rows: DataFrame, value: Column, groups: list[str], decimals: int = 6, width: float = 1.0) -> DataFrame:
    """(groups, value, n, upto): each distinct value with its count and the number of rows at or below it.

    Cells of `decimals` places are cumulated in slices of `width`; inside a cell the values themselves are in order, so the
    result is exact for values of any size. Only where very many distinct values share a cell does a window grow long.
    """
    scale, most = float(10**decimals), 2.0**62
    cell = F.greatest(F.least(F.floor(value.cast("double") * scale).cast("double"), F.lit(most)), F.lit(-most))
    keyed = rows.where(value.isNotNull()).select(*groups, value.cast("double").alias("value"), cell.cast("bigint").alias("t"))
    counts = keyed.groupBy(*groups, "t", "value").agg(F.count("*").alias("n"))
    same = Window.partitionBy(*groups, "t")
    upto_here = same.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumns({
        "_g": F.lit(0), "upto": F.col("n"), "cell_n": F.sum("n").over(same), "inside": F.sum("n").over(upto_here)})
    # The row's own count rides along, so that a rank can be located between `upto - n` and `upto`.
    cumulated = sliced_totals(
        placed, [*groups, "_g"], ["upto"], ["value", "n", "cell_n", "inside"], int(width * scale))
    return cumulated.select(*groups, "value", "n", (F.col("upto") - F.col("cell_n") + F.col("inside")).alias("upto"))


def at_ranks(ranked: DataFrame, groups: list[str], wanted: Column) -> DataFrame:
    """Values at 0-based positions. `wanted` is an array of structs (name, position double) over `n_rows`; a fractional
    position interpolates between its neighbours."""
    totals = ranked.groupBy(*groups).agg(F.max("upto").alias("n_rows"))
    asked = totals.select(*groups, F.explode(wanted).alias("w")).select(
        *groups, "w.name", F.col("w.position").alias("position"))
    low, high = F.floor("position"), F.ceil("position")
    join_on = groups or None
    # Groups are as many as the data has; without groups `asked` has one row per point.
    paired = ranked.join(asked, join_on) if join_on else ranked.crossJoin(F.broadcast(asked))
    first, last = F.col("upto") - F.col("n"), F.col("upto")

    def holds(position: Column) -> Column:
        return (position >= first) & (position < last)

    found = paired.where(holds(low) | holds(high)).groupBy(*groups, "name", "position").agg(
        F.max(F.when(holds(low), F.col("value"))).alias("lo"), F.max(F.when(holds(high), F.col("value"))).alias("hi"))
    share = F.col("position") - F.floor("position")
    return found.select(*groups, "name", (F.col("lo") * (1 - share) + F.col("hi") * share).alias("value"))


def quantiles(rows: DataFrame, value: Column, points: dict[str, float], groups: list[str] | None = None) -> DataFrame:
    """Interpolated quantiles {name: p}, one column per name."""
    groups = groups or []
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), ((F.col("n_rows") - 1) * F.lit(p)).alias("position"))
        for name, p in points.items()])
    return _wide(at_ranks(ranked_values(rows, value, groups), groups, wanted), groups, list(points))


def nearest_ranks(rows: DataFrame, value: Column, points: dict[str, float], groups: list[str] | None = None) -> DataFrame:
    """The value at position floor(n * p) of the sorted rows, one column per name."""
    groups = groups or []
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"),
                 F.floor(F.col("n_rows") * F.lit(p)).cast("double").alias("position")) for name, p in points.items()])
    return _wide(at_ranks(ranked_values(rows, value, groups), groups, wanted), groups, list(points))


def _wide(found: DataFrame, groups: list[str], names: list[str]) -> DataFrame:
    return found.groupBy(*groups).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
