"""Point-in-time operators over keyed timelines: range totals, range distinct counts, previous rows, percentiles.

A sliding range frame re-reads its frame for every row, and a window puts a whole key into one task. Here gains and
losses turn range frames into running totals, which cost one step per row. Timelines of ordinary length are windows by
key. A key may also hold a third of all rows: `hot_keys` finds such keys by count, and their timelines are cut into time
slices. Every slice is a window partition of its own and starts from one *carry row* that stands for everything before
it. Carry rows come from one aggregate row per (key, slice), so no window over a whole hot key reads its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskspark.constants import DAY, HOUR
from riskspark.session import checkpoint_dir

UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
HOT_ROWS = 2_000_000
LISTED_KEYS = 10_000


def hot_keys(rows: DataFrame, key: str, limit: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than `limit` rows, or None. One counting job; up to 10,000 keys come back as a literal table,
    more stay a checkpointed table that Spark joins as its size allows."""
    counted = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(key)
    found = counted.limit(LISTED_KEYS + 1).collect()
    if not found:
        return None
    if len(found) <= LISTED_KEYS:
        return rows.sparkSession.createDataFrame(found, counted.schema)
    checkpoint_dir(rows.sparkSession)
    return counted.checkpoint()


def _both(rows: DataFrame, key: str, hot: DataFrame | None, plain, sliced) -> DataFrame:
    """`plain` over the ordinary keys and `sliced` over the hot ones."""
    if hot is None:
        return plain(rows)
    keys = hot.select(key)
    return plain(rows.join(keys, key, "left_anti")).unionByName(sliced(rows.join(keys, key, "left_semi")))


def slice_start(time: str, width: int) -> Column:
    return F.col(time) - F.pmod(F.col(time), F.lit(width))


def running_totals(
    rows: DataFrame, keys: list[str], measures: list[str], keep: list[str] | None = None, width: int = HOUR,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Replace each measure by its total over all rows of the key at or before the row's time `t`.

    Rows of equal time are peers and see the same totals. `rows` holds keys, `t` (microseconds), the measures and the
    columns to `keep`. `hot` lists hot values of the first key.
    """
    keep = keep or []
    typed = rows.select(*keys, "t", *keep, *[F.col(m).cast("bigint").alias(m) for m in measures])

    def plain(part: DataFrame) -> DataFrame:
        upto = Window.partitionBy(*keys).orderBy("t").rangeBetween(*UP_TO_HERE)
        return part.select(*keys, "t", *keep, *[F.sum(m).over(upto).alias(m) for m in measures])

    return _both(typed, keys[0], hot, plain, lambda part: sliced_totals(part, keys, measures, keep, width))


def sliced_totals(rows: DataFrame, keys: list[str], measures: list[str], keep: list[str], width: int) -> DataFrame:
    """Running totals of timelines of any length; see `running_totals`."""
    cut = rows.select(*keys, slice_start("t", width).alias("_slice"), "t", *keep,
                      *[F.col(m).cast("bigint").alias(m) for m in measures])
    per_slice = cut.groupBy(*keys, "_slice").agg(*[F.sum(m).alias(m) for m in measures])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_slice.select(
        *keys, "_slice", F.col("_slice").alias("t"), F.lit(True).alias("_carry"),
        *[F.sum(m).over(before).alias(m) for m in measures],
    ).where(F.col(measures[0]).isNotNull())
    upto = Window.partitionBy("_slice", *keys).orderBy("t").rangeBetween(*UP_TO_HERE)
    return (
        cut.withColumn("_carry", F.lit(False)).unionByName(carry, allowMissingColumns=True)
        .select(*keys, "t", "_carry", *keep, *[F.sum(m).over(upto).alias(m) for m in measures])
        .where(~F.col("_carry"))
        .drop("_carry")
    )


def with_neighbours(rows: DataFrame, keys: list[str], width: int = HOUR, hot: DataFrame | None = None) -> DataFrame:
    """Add the times of the key's previous and next row as `prev_t` and `next_t`. `rows` holds keys and `t`, one row
    per (keys, t)."""

    def both_sides(part: DataFrame, *slice_key: str) -> DataFrame:
        order = Window.partitionBy(*slice_key, *keys).orderBy("t")
        return part.withColumns({"prev_t": F.lag("t").over(order), "next_t": F.lead("t").over(order)})

    def sliced(part: DataFrame) -> DataFrame:
        cut = part.withColumn("_slice", slice_start("t", width))
        ends = cut.groupBy(*keys, "_slice").agg(F.min("t").alias("first"), F.max("t").alias("last"))
        by_slice = Window.partitionBy(*keys).orderBy("_slice")
        # The last row before a slice and the first row after it stand beside its own rows.
        outside = ends.withColumns({
            "_before": F.lag("last").over(by_slice), "_after": F.lead("first").over(by_slice)})
        ghosts = outside.select(*keys, "_slice", F.lit(True).alias("_ghost"), F.explode(
            F.array("_before", "_after")).alias("t")).where(F.col("t").isNotNull())
        marked = cut.withColumn("_ghost", F.lit(False)).unionByName(ghosts)
        return both_sides(marked, "_slice").where(~F.col("_ghost")).drop("_slice", "_ghost")

    return _both(rows, keys[0], hot, both_sides, sliced)


def with_previous(
    rows: DataFrame, key: str, time: str, tie: str, carried: dict[str, str], width: int = HOUR,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Add, for each row, the previous row's time as `prev_t` and the last earlier non-null value of each column in
    `carried` ({column: output name}); earlier means strictly before in (time, tie) order within the key."""

    def looked_back(part: DataFrame, order) -> DataFrame:
        earlier = order.rowsBetween(Window.unboundedPreceding, -1)
        return part.withColumn("prev_t", F.lag(time).over(order)).withColumns(
            {out: F.last(c, ignorenulls=True).over(earlier) for c, out in carried.items()})

    def plain(part: DataFrame) -> DataFrame:
        return looked_back(part, Window.partitionBy(key).orderBy(time, tie))

    def sliced(part: DataFrame) -> DataFrame:
        cut = part.withColumn("_slice", slice_start(time, width)).withColumn("_ghost", F.lit(False))
        position = F.struct(F.col(time), F.col(tie))
        lasts = cut.groupBy(key, "_slice").agg(
            F.max(time).alias(time),
            *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), position)).alias(c) for c in carried],
        )
        by_slice = Window.partitionBy(key).orderBy("_slice")
        until = by_slice.rowsBetween(*UP_TO_HERE)
        ghosts = (
            lasts.select(
                key, F.lead("_slice").over(by_slice).alias("_slice"), time,
                *[F.last(c, ignorenulls=True).over(until).alias(c) for c in carried],
            )
            .where(F.col("_slice").isNotNull())
            .withColumn("_ghost", F.lit(True))
        )
        order = Window.partitionBy("_slice", key).orderBy(F.col(time), F.col("_ghost").desc(), F.col(tie))
        return looked_back(cut.unionByName(ghosts, allowMissingColumns=True), order).where(~F.col("_ghost")).drop(
            "_slice", "_ghost")

    return _both(rows, key, hot, plain, sliced)


def expiring(rows: DataFrame, until: Column, measures: dict[str, Column], keep: list[str]) -> DataFrame:
    """Each row as a gain at `t` and the matching loss at `until`: its running total counts the live rows."""
    columns = [value.cast("bigint") for value in measures.values()]
    both = F.stack(F.lit(2), F.col("t"), *columns, until.cast("bigint"), *[-value for value in columns])
    return rows.select(*keep, both.alias("t", *measures))


def live_members(
    pairs: DataFrame, keys: list[str], member: str, horizon: Column | int, out: str, hot: DataFrame | None = None
) -> DataFrame:
    """Gains and losses whose running total per key is the number of distinct members seen in [t - horizon, t].

    Sightings of a member that follow each other within the horizon form one stay: a gain at its first sighting, a loss
    when the horizon after its last one has passed.
    """
    span = horizon if isinstance(horizon, Column) else F.lit(horizon)
    sightings = with_neighbours(pairs.select(*keys, member, "t").distinct(), [*keys, member], hot=hot)
    starts = F.col("prev_t").isNull() | (F.col("prev_t") < F.col("t") - span)
    ends = F.col("next_t").isNull() | (F.col("next_t") > F.col("t") + span)
    one = F.lit(1).cast("bigint")
    both = F.stack(F.lit(2), F.when(starts, F.col("t")), one, F.when(ends, F.col("t") + span + F.lit(1)), -one)
    return sightings.where(starts | ends).select(*keys, both.alias("t", out)).where(F.col("t").isNotNull())


def _rolling_quantile(horizon: int, quantile: float):
    """pandas over one sorted partition: quantile of the values in [t - horizon, t] for every row's time.

    Batches hold many timelines. They are laid end to end on one clock with gaps longer than the horizon, so a single
    rolling call serves the whole batch. The rows of the last timeline still inside the horizon go on to the next batch.
    """

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            batch = batch.assign(open=True)
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            if batch.empty:
                continue
            t = batch["t"].to_numpy()
            new = np.ones(len(batch), dtype=bool)
            new[1:] = batch["entity"].to_numpy()[1:] != batch["entity"].to_numpy()[:-1]
            step = np.diff(t, prepend=t[0])
            step[new] = horizon + 1
            clock = np.cumsum(step).astype("datetime64[us]")
            window = pd.Series(batch["value"].to_numpy(), index=clock).rolling(
                pd.Timedelta(horizon, unit="us"), closed="both")
            batch["quantile"] = window.quantile(quantile, interpolation="linear").to_numpy()
            start = np.flatnonzero(new)[-1]
            # Peers of the last time may still follow: its rows stay open until the next batch.
            closed = np.arange(len(batch)) < start
            closed[start:] = t[start:] < t[-1]
            last_of_time = np.ones(len(batch), dtype=bool)
            last_of_time[:-1] = new[1:] | (t[1:] != t[:-1])
            yield batch[closed & last_of_time & batch["open"].to_numpy()][["entity", "t", "quantile"]]
            held = batch.iloc[start:][t[start:] >= t[-1] - horizon].drop(columns="quantile")
            held.loc[held["t"] < t[-1], "open"] = False
            held = held.reset_index(drop=True)
        if held is not None and bool(held["open"].iloc[-1]):
            last = held.iloc[[-1]]
            yield pd.DataFrame({
                "entity": last["entity"], "t": last["t"],
                "quantile": float(np.quantile(held["value"].to_numpy(), quantile)),
            })

    return job


def range_quantile(
    rows: DataFrame, key: str, horizon: int, quantile: float, hot: DataFrame | None = None
) -> DataFrame:
    """Exact interpolated quantile of `value` over [t - horizon, t]: one row (key, t, quantile) per time.

    `rows` holds the key, `t` and the whole number `value`. A task walks its sorted timelines batch by batch and keeps
    one horizon of one ordinary timeline; hot ones go through `hot_range_quantile`.
    """

    def plain(part: DataFrame) -> DataFrame:
        return (
            part.select(F.col(key).alias("entity"), "t", F.col("value").cast("double").alias("value"))
            .repartition("entity")
            .sortWithinPartitions("entity", "t")
            .mapInPandas(_rolling_quantile(horizon, quantile), "entity string, t long, quantile double")
            .withColumnRenamed("entity", key)
        )

    return _both(rows, key, hot, plain, lambda part: hot_range_quantile(part, key, horizon, quantile))


DIGIT_BITS = 4


def hot_range_quantile(rows: DataFrame, key: str, horizon: int, quantile: float, width: int = HOUR) -> DataFrame:
    """The same quantile for timelines too long for one task.

    The value at a rank is found digit by digit, highest first. In each round every value belongs to the node of its
    leading digits; running totals over the node's timeline count, for each next digit, the values inside the horizon;
    a query moves to the digit that holds its rank. All rounds are sliced running totals, so nothing grows with the key.
    """
    spark = rows.sparkSession
    checkpoint_dir(spark)
    points = rows.groupBy(key, "t", "value").agg(F.count("*").alias("n")).checkpoint()
    low, high = points.agg(F.min("value"), F.max("value")).first()
    levels = max(1, math.ceil((high - low).bit_length() / DIGIT_BITS))
    points = points.withColumn("value", F.col("value") - F.lit(low))
    counts = points.groupBy(key, "t").agg(F.sum("n").alias("n"))
    live = sliced_totals(
        expiring(counts, F.col("t") + F.lit(horizon + 1), {"n": F.col("n")}, [key]),
        [key], ["n"], [], width).groupBy(key, "t").agg(F.max("n").alias("total"))
    position = (F.col("total") - 1) * F.lit(quantile)
    asked = counts.select(key, "t").join(live, [key, "t"]).withColumn("position", position)
    queries = asked.select(key, "t", "position", F.explode(F.array(
        F.struct(F.lit("lo").alias("which"), F.floor("position").alias("rank")),
        F.struct(F.lit("hi").alias("which"), F.ceil("position").alias("rank")))).alias("q")).select(
        key, "t", "position", "q.which", "q.rank", F.lit(0).cast("bigint").alias("node")).checkpoint()
    base = 1 << DIGIT_BITS
    measures = [f"c{i}" for i in range(base)]
    for level in reversed(range(levels)):
        shift = DIGIT_BITS * level
        digit = F.shiftright("value", shift).bitwiseAND(F.lit(base - 1))
        node = F.shiftright("value", shift + DIGIT_BITS)
        digits = {m: F.when(digit == i, F.col("n")).otherwise(F.lit(0)) for i, m in enumerate(measures)}
        changes = expiring(points.withColumn("node", node), F.col("t") + F.lit(horizon + 1), digits, [key, "node"])
        timeline = changes.unionByName(queries, allowMissingColumns=True).fillna(0, measures)
        seen = sliced_totals(timeline, [key, "node"], measures, ["position", "which", "rank"], width).where(
            F.col("which").isNotNull())
        below, chosen, skipped = F.lit(0), None, None
        for i, m in enumerate(measures):
            through = below + F.col(m)
            hit = F.col("rank") < through
            chosen = F.when(hit, F.lit(i)) if chosen is None else chosen.when(hit, F.lit(i))
            skipped = F.when(hit, below) if skipped is None else skipped.when(hit, below)
            below = through
        queries = seen.select(
            key, "t", "position", "which", (F.col("rank") - skipped).alias("rank"),
            (F.col("node") * base + chosen).alias("node")).checkpoint()
    share = F.first("position") - F.floor(F.first("position"))
    lo = F.max(F.when(F.col("which") == "lo", F.col("node"))) + F.lit(low)
    hi = F.max(F.when(F.col("which") == "hi", F.col("node"))) + F.lit(low)
    return queries.groupBy(key, "t").agg((lo + (hi - lo) * share).alias("quantile"))
