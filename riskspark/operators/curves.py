"""Curves over scores: cumulative thresholds, AUC and average precision, global ranks. All compare unrounded scores.

Thresholds: each row falls into a bucket between two thresholds, and a few rows remain after partial aggregation. Ranking
metrics need the place of every distinct score in the order of all; `ranks.running` finds it by range partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskspark.functions.numeric import ratio, rnd
from riskspark.operators import ranks

MONEY_SUM = "decimal(38,2)"


def scores_in_order(rows: DataFrame, groups: list[str]) -> DataFrame:
    """n, positives and fraud amount per (groups, unrounded probability), with the totals of lower scores (`_before`) and of
    all (`_total`). `is_fraud` may be null; rows without a score come first."""
    fraud = F.coalesce("is_fraud", F.lit(False))
    peers = rows.groupBy(*groups, "probability").agg(
        F.count("*").alias("n"), F.count_if(fraud).alias("n_fraud"),
        F.sum(F.when(fraud, F.col("amount_usd")).otherwise(F.lit(0))).cast(MONEY_SUM).alias("fraud_usd"))
    return ranks.running(peers, groups, ["probability"], ["n", "n_fraud"])


def bucket_of(value: Column, cuts: list[float]) -> Column:
    """How many of the ascending cuts are at or below a value: a binary tree of comparisons, so it compiles."""
    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= F.lit(float(cuts[middle])), tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(cuts))


def threshold_buckets(rows: DataFrame, cuts: list[float]) -> DataFrame:
    """n, n_fraud, fraud_usd, legit_usd per bucket: the number of ascending cuts at or below the unrounded score."""
    fraud = F.coalesce("is_fraud", F.lit(False))
    return rows.where(F.col("probability").isNotNull()).groupBy(bucket_of(F.col("probability"), cuts).alias("bucket")).agg(
        F.count("*").alias("n"), F.count_if(fraud).alias("n_fraud"),
        F.sum(F.when(fraud, F.col("amount_usd")).otherwise(F.lit(0))).cast(MONEY_SUM).alias("fraud_usd"),
        F.sum(F.when(~fraud, F.col("amount_usd")).otherwise(F.lit(0))).cast(MONEY_SUM).alias("legit_usd"))


def threshold_totals(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Totals at or above and below each threshold, from one bucket per row and two cumulative sums over the buckets.
    `rows` holds probability, amount_usd and is_fraud (may be null); rows without a score are left out."""
    cuts = sorted(thresholds)
    measures = ["n", "n_fraud", "fraud_usd", "legit_usd"]
    per_bucket = threshold_buckets(rows, cuts)
    table = rows.sparkSession.createDataFrame(
        [(i, float(cuts[i - 1]) if i else None) for i in range(len(cuts) + 1)], "bucket int, threshold double")
    filled = F.broadcast(table).join(per_bucket, "bucket", "left").fillna(0, measures).select(
        "bucket", "threshold", *[F.coalesce(m, F.lit(0)).alias(m) for m in measures])
    # One row per threshold: this window is as small as the threshold list.
    above = Window.orderBy("bucket").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    below = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    out = filled.select(
        "threshold",
        *[F.sum(m).over(above).alias(f"{m}_above") for m in measures],
        *[F.coalesce(F.sum(m).over(below), F.lit(0)).alias(f"{m}_below") for m in measures],
    ).where(F.col("threshold").isNotNull())
    return out.select(
        "threshold", F.col("n_fraud_above").alias("tp"), (F.col("n_above") - F.col("n_fraud_above")).alias("fp"),
        F.col("n_fraud_below").alias("fn"), (F.col("n_below") - F.col("n_fraud_below")).alias("tn"),
        F.col("fraud_usd_above").cast("double").alias("prevented_usd"),
        F.col("fraud_usd_below").cast("double").alias("missed_usd"),
        F.col("legit_usd_above").cast("double").alias("fp_usd"))


def ranking_metrics(ordered: DataFrame, groups: list[str]) -> DataFrame:
    """Exact AUC (ties averaged) and average precision per group of `scores_in_order`; null where a class is missing."""
    legit_below = F.col("n_before") - F.col("n_fraud_before")
    wins = F.sum((F.col("n_fraud") * (2 * legit_below + F.col("n") - F.col("n_fraud"))).cast("decimal(38,0)"))
    precision = (F.col("n_fraud_total") - F.col("n_fraud_before")).cast("double") / (F.col("n_total") - F.col("n_before"))
    total, legit = F.sum("n_fraud"), F.sum("n") - F.sum("n_fraud")
    pairs = F.when((total > 0) & (legit > 0), 2.0 * total.cast("double") * legit.cast("double"))
    return ordered.groupBy(*groups).agg(
        rnd(wins.cast("double") / pairs, 6).alias("auc_roc"),
        rnd(F.when((total > 0) & (legit > 0), F.sum(F.col("n_fraud") * precision) / total), 6).alias("auc_pr"))


def confusion(ordered: DataFrame, groups: list[str], decline: float, review: float) -> DataFrame:
    """Counts and shares at the review cut, approval mix by score, and loss sums, per group."""
    at_review, at_decline = F.col("probability") >= review, F.col("probability") >= decline

    def total(column: str, test) -> F.Column:
        return F.sum(F.when(test, F.col(column)).otherwise(F.lit(0)))

    sums = ordered.groupBy(*groups).agg(
        F.sum("n").alias("sample_size"), F.sum("n_fraud").alias("n_fraud"),
        total("n_fraud", at_review).alias("tp"), total("n", at_review).alias("n_review_up"),
        total("n", at_decline).alias("n_decline"),
        F.sum("fraud_usd").cast("double").alias("expected_loss"),
        total("fraud_usd", at_review).cast("double").alias("prevented_loss"))
    tp, size = F.col("tp"), F.col("sample_size")
    fp, fn = F.col("n_review_up") - tp, F.col("n_fraud") - tp
    tn = size - F.col("n_review_up") - fn
    return sums.select(
        *groups, "sample_size", ratio(F.col("n_fraud"), size).alias("fraud_rate"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(fp, fp + tn).alias("false_positive_rate"), ratio(fn, fn + tp).alias("false_negative_rate"),
        ratio(size - F.col("n_review_up"), size).alias("approval_rate"),
        ratio(F.col("n_decline"), size).alias("decline_rate"),
        ratio(F.col("n_review_up") - F.col("n_decline"), size).alias("review_rate"),
        rnd(F.col("expected_loss"), 2).alias("expected_loss"), rnd(F.col("prevented_loss"), 2).alias("prevented_loss"))


def top_share_totals(rows: DataFrame, shares: list[float]) -> DataFrame:
    """Totals over the highest-scored share of all rows, ties broken by id, then largest fraud first, then known genuine
    rows. `rows` holds auth_event_id, probability, amount_usd and is_fraud (may be null); rows without a score come last.

    Rows that agree in all of this are one row with a count, which one pass of running totals places; a share ends inside
    one of these rows and takes as many of its members as it needs.
    """
    fraud = F.coalesce("is_fraud", F.lit(False))
    cents = F.when(fraud, (F.col("amount_usd") * 100).cast("bigint")).otherwise(F.lit(0))
    legit = F.when(F.col("is_fraud") == F.lit(False), 1).otherwise(0)
    alike = rows.groupBy(
        F.coalesce(-F.col("probability"), F.lit(float("inf"))).alias("down"), F.col("auth_event_id").alias("id"),
        (-cents).alias("less"), (-legit).alias("unknown")).agg(F.count("*").alias("own")).select(
        "*", (-F.col("less") * F.col("own")).cast("decimal(38,0)").alias("cents"),
        (-F.col("unknown") * F.col("own")).alias("legit"))
    placed = ranks.running(alike, [], ["down", "id", "less", "unknown"], ["own", "cents", "legit"])
    first, last = F.col("own_before"), F.col("own_before") + F.col("own")
    cuts = [F.least(F.floor(F.col("own_total") * F.lit(share)), F.col("own_total")) for share in shares]
    ends = [(cut > first) & (cut <= last) for cut in cuts]
    ending = placed.where(reduce(lambda a, b: a | b, ends)).select(F.explode(F.array_compact(F.array(*[
        F.when(end, F.struct(
            F.lit(k).alias("step"), cut.alias("n"),
            ((F.col("cents_before") - (cut - first) * F.col("less")).cast("decimal(20,0)") / 100).cast("double").alias("fraud_usd"),
            (F.col("legit_before") - (cut - first) * F.col("unknown")).alias("n_legit")))
        for k, (cut, end) in enumerate(zip(cuts, ends, strict=True), 1)]))).alias("_")).select("_.*")
    steps = rows.sparkSession.createDataFrame([(k,) for k in range(1, len(shares) + 1)], "step int")
    return steps.join(F.broadcast(ending), "step", "left").select(  # one row per share at most
        "step", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "fraud_usd", "n_legit")])
