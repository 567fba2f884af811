"""Distribution comparison: long feature values, equal-width histograms, PSI, Jensen-Shannon, Kolmogorov-Smirnov."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.numeric import rnd
from riskspark.operators import ranks

BINS = 10
EXACT = "decimal(20,4)"


def long_features(rows: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """One row per (row, feature): a single pass instead of one per feature."""
    pairs = [item for name in names for item in (F.lit(name), F.col(name).cast("double"))]
    return rows.select(*keep, F.stack(F.lit(len(names)), *pairs).alias("feature", "value"))


def binned_features(rows: DataFrame, names: list[str], groups: list[str], side: str) -> DataFrame:
    """Counts per (groups, feature, bin 0..9) for both sides over their joint range, with range, means and null counts.

    `side` is a boolean column: true for the later (production) side. Ranges come from one aggregate over the wide rows,
    the bin of each value is found in its row, and what is shuffled are counts per bin, not values.
    """
    p = F.col(side)
    values = [F.col(name).cast("double") for name in names]
    wide = rows.groupBy(*groups).agg(*[F.struct(
        F.lit(name).alias("feature"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.sum(F.when(~p, v.cast(EXACT))).cast("double").alias("train_sum"),
        F.sum(F.when(p, v.cast(EXACT))).cast("double").alias("prod_sum"),
        F.count(F.when(~p, v)).alias("n_train"), F.count(F.when(p, v)).alias("n_prod"),
        F.count_if(p).alias("prod_rows")).alias(f"_f{i}") for i, (name, v) in enumerate(zip(names, values, strict=True))])
    parts = F.array(*[F.col(f"_f{i}") for i in range(len(names))])
    spread = wide.select(*groups, F.explode(parts).alias("_s")).select(*groups, "_s.*")
    ranges = wide.select(*groups, parts.alias("_ranges"))
    placed = rows.join(ranges, groups) if groups else rows.crossJoin(F.broadcast(ranges))  # one row without groups
    items = []
    for i, (name, v) in enumerate(zip(names, values, strict=True)):
        lo, hi = F.col("_ranges")[i]["lo"], F.col("_ranges")[i]["hi"]
        # `least` passes over nulls, so they are left out first.
        items += [F.lit(name), F.when((hi > lo) & v.isNotNull(), F.least(F.floor((v - lo) / (hi - lo) * BINS), F.lit(BINS - 1)))]
    bins = placed.select(*groups, side, F.stack(F.lit(len(names)), *items).alias("feature", "bin")).where(
        F.col("bin").isNotNull()).groupBy(*groups, "feature", "bin").agg(
        F.count_if(~p).alias("t"), F.count_if(p).alias("q"))
    keys = [*groups, "feature"]
    table = bins.groupBy(*keys).agg(*[
        F.coalesce(F.sum(F.when(F.col("bin") == b, F.col(c))), F.lit(0)).alias(f"{c}{b}")
        for b in range(BINS) for c in ("t", "q")])
    return spread.join(table, keys, "left")


def _sum(parts: list[Column]) -> Column:
    total = F.lit(0.0)
    for part in parts:
        total = total + part
    return total


def _sides() -> list[tuple[Column, Column]]:
    return [(F.col(f"t{b}").cast("double"), F.col(f"q{b}").cast("double")) for b in range(BINS)]


def psi_clipped() -> Column:
    """Population stability index with shares clipped at 1e-6; 0 where the range is degenerate or a side is empty."""
    n_t, n_q = F.col("n_train").cast("double"), F.col("n_prod").cast("double")
    parts = []
    for t, q in _sides():
        e, a = F.greatest(t / n_t, F.lit(1e-6)), F.greatest(q / n_q, F.lit(1e-6))
        parts.append((a - e) * F.log(a / e))
    ok = (F.col("hi") > F.col("lo")) & (n_t > 0) & (n_q > 0)
    return F.coalesce(F.when(ok, _sum(parts)), F.lit(0.0))


def psi_smoothed() -> Column:
    """The scheduled variant: 1e-10 added to counts and totals, never negative."""
    n_t, n_q = F.col("n_train").cast("double") + F.lit(1e-10), F.col("n_prod").cast("double") + F.lit(1e-10)
    parts = []
    for t, q in _sides():
        e, a = (t + F.lit(1e-10)) / n_t, (q + F.lit(1e-10)) / n_q
        parts.append((a - e) * F.log(a / e))
    ok = (F.col("hi") > F.col("lo")) & (F.col("n_train") > 0) & (F.col("n_prod") > 0)
    return F.coalesce(F.when(ok, F.greatest(F.lit(0.0), _sum(parts))), F.lit(0.0))


def jensen_shannon() -> Column:
    """Natural-log divergence of the two histograms, 1e-10 added to each count and renormalised."""
    sides = _sides()
    tiny = F.lit(1e-10)
    n_t, n_q = F.col("n_train") + F.lit(BINS * 1e-10), F.col("n_prod") + F.lit(BINS * 1e-10)
    parts = []
    for t, q in sides:
        a, b = (t + tiny) / n_t, (q + tiny) / n_q
        m = F.lit(0.5) * (a + b)
        parts.append(F.lit(0.5) * a * F.log(a / m) + F.lit(0.5) * b * F.log(b / m))
    ok = (F.col("hi") > F.col("lo")) & (F.col("n_train") > 0) & (F.col("n_prod") > 0)
    return F.coalesce(F.when(ok, _sum(parts)), F.lit(0.0))


def mean(total: str, n: str) -> Column:
    return rnd(F.coalesce(F.col(total) / F.nullif(F.col(n), F.lit(0)), F.lit(0.0)), 4)


def ks_statistic(rows: DataFrame, value: Column, side: Column, groups: list[str] | None = None) -> DataFrame:
    """Largest gap between the two empirical distribution functions of a value; equal values are peers."""
    groups = groups or []
    counts = rows.select(*groups, value.alias("value"), side.alias("side")).groupBy(*groups, "value").agg(
        F.count_if(F.col("side")).alias("a"), F.count_if(~F.col("side")).alias("b"))
    share = lambda c: (F.col(f"{c}_before") + F.col(c)) / F.col(f"{c}_total")
    placed = ranks.running(counts, groups, ["value"], ["a", "b"])
    return placed.groupBy(*groups).agg(
        rnd(F.max(F.abs(share("a") - share("b"))), 6).alias("ks"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
