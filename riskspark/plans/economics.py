"""What fraud cost and what each threshold would have saved."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import constants as C
from riskspark.functions.numeric import first_nonzero, ratio, rnd
from riskspark.operators import curves
from riskspark.operators.merge import latest
from riskspark.plans.lake import Lake

SWEEP = [float(t) for t in np.arange(0.05, 0.96, 0.01)]
SCREEN_SWEEP = [i / 100 for i in range(5, 100, 5)]


def threshold_triples() -> list[tuple[float, float, float]]:
    """All (decline, review, step-up) candidates, in search order."""
    return [
        (float(d), float(r), float(s))
        for d in np.arange(0.70, 0.96, 0.05)
        for r in np.arange(0.30, d, 0.05)
        for s in np.arange(0.10, r, 0.05)
    ]


def decision_log(scored: DataFrame) -> DataFrame:
    """Decisions of the test data: none for every 41st event, a later override for every 20th."""
    e = F.col("auth_event_id")
    rows = F.array_compact(F.array(
        F.when(e % 41 != 0, F.struct(
            (e * 2).alias("decision_id"), F.col("event_time").alias("decision_time"),
            F.col("decision").alias("decision_type"))),
        F.when(e % 20 == 0, F.struct(
            (e * 2 + 1).alias("decision_id"),
            (F.col("event_time") + F.make_dt_interval(F.lit(0), F.lit(1))).alias("decision_time"),
            F.when(e % 40 == 0, "soft_decline").otherwise("allow_with_monitoring").alias("decision_type")))))
    return scored.select("auth_event_id", "model_version", "final_score", F.explode(rows).alias("d")).select(
        "auth_event_id", "model_version", "final_score", "d.*")


def fraud_events(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Events with any fraud label."""
    return events.join(labels.where("is_fraud"), "auth_event_id", "left_semi")


def nonfraud_events(events: DataFrame, labels: DataFrame) -> DataFrame:
    return events.join(labels.where("is_fraud"), "auth_event_id", "left_anti")


def latest_decision(decisions: DataFrame) -> DataFrame:
    return latest(decisions, ["auth_event_id"], ["decision_time", "decision_id"], ["decision_type", "decision_time"])


def latest_label(labels: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """Per event its last label by receipt; with a cut-off, only labels received by then are seen."""
    if cutoff is not None:
        labels = labels.where(F.col("label_received_at") <= cutoff)
    return latest(labels, ["auth_event_id"], ["label_received_at", "label_id"],
                  ["is_fraud", "label_source", "label_received_at"])


def decided_events(events: DataFrame, labels: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per event: amount, any-fraud flag, latest decision and counts over all its decisions."""
    kind = F.lower("decision_type")
    per_event = decisions.groupBy("auth_event_id").agg(
        F.max_by(kind, F.struct("decision_time", "decision_id")).alias("decision_type"),
        F.count_if(kind.isin("approve", "allow_with_monitoring")).alias("n_approved"),
        F.count_if(kind.contains("decline")).alias("n_declined"),
        F.count_if(kind == "manual_review").alias("n_review"),
        F.count_if(kind == "step_up").alias("n_step_up"))
    fraud = labels.groupBy("auth_event_id").agg(F.bool_or("is_fraud").alias("is_fraud"))
    return (
        events.withColumn("amount_usd", first_nonzero(F.col("billing_amount_usd"), F.col("auth_amount")))
        .join(per_event, "auth_event_id", "left")
        .join(fraud, "auth_event_id", "left")
        .fillna(0, ["n_approved", "n_declined", "n_review", "n_step_up"])
        .withColumn("is_fraud", F.coalesce("is_fraud", F.lit(False)))
    )


def business_metrics(decided: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """The 17 figures. Fraud without a decision counts as prevented; friction includes reviews."""
    fraud = F.col("is_fraud")
    declined = F.coalesce(F.col("decision_type").contains("decline"), F.lit(False))
    stopped = F.col("decision_type").isNull() | declined | (F.col("decision_type") == "manual_review")
    false_alarm = ~fraud & declined

    def money(test: Column) -> Column:
        return F.sum(F.when(test, F.col("amount_usd")).otherwise(F.lit(0)))

    sums = decided.groupBy(*(groups or [])).agg(
        F.count("*").alias("total_transactions"), F.sum("amount_usd").alias("_volume"),
        F.count_if(fraud).alias("fraud_transactions"), money(fraud).alias("_fraud"),
        money(fraud & stopped).alias("_prevented"), F.count_if(false_alarm).alias("false_positive_count"),
        money(false_alarm).alias("_false"), F.coalesce(F.sum("n_review"), F.lit(0)).alias("manual_review_count"),
        F.coalesce(F.sum("n_approved"), F.lit(0)).alias("_approved"),
        F.coalesce(F.sum("n_declined"), F.lit(0)).alias("_declined"),
        F.coalesce(F.sum("n_step_up"), F.lit(0)).alias("_step_up"))
    n = F.col("total_transactions")

    def usd(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0)).cast("double")

    cost = F.col("manual_review_count") * F.lit(C.REVIEW_COST_USD)
    return sums.select(
        *(groups or []), n, rnd(usd("_volume"), 2).alias("total_volume_usd"), "fraud_transactions",
        rnd(usd("_fraud"), 2).alias("fraud_volume_usd"), rnd(usd("_prevented"), 2).alias("prevented_fraud_usd"),
        rnd(usd("_fraud") - usd("_prevented"), 2).alias("missed_fraud_usd"), "false_positive_count",
        rnd(usd("_false"), 2).alias("false_positive_volume_usd"), "manual_review_count",
        cost.alias("manual_review_cost_usd"), ratio(F.col("_approved"), n).alias("approval_rate"),
        ratio(F.col("_declined"), n).alias("decline_rate"), ratio(F.col("manual_review_count"), n).alias("review_rate"),
        ratio(F.col("_step_up"), n).alias("challenge_rate"),
        ratio(usd("_fraud") * 10000, usd("_volume")).alias("fraud_basis_points"),
        rnd(usd("_prevented") - usd("_false") - cost, 2).alias("net_fraud_savings_usd"),
        ratio(F.col("_declined") + F.col("_step_up") + F.col("manual_review_count"), n)
        .alias("customer_friction_rate"))


def _decided(lake: Lake, extra: DataFrame | None = None) -> DataFrame:
    events = lake.auth_events if extra is None else extra
    return decided_events(events, lake.labels, lake.decisions)


def summary(lake: Lake, start=None, end=None, country: str | None = None) -> DataFrame:
    """The 17 figures over [start, end), optionally for one merchant country; zeros when nothing matches."""
    events = within(lake.auth_events, start, end)
    if country is not None:
        events = events.where(F.col("merchant_country_code") == country)
    return business_metrics(_decided(lake, events))


def within(rows: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """The rows of [start, end); a side that is None is open."""
    if start is not None:
        rows = rows.where(F.col("event_time") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.where(F.col("event_time") < F.lit(end).cast("timestamp_ntz"))
    return rows


def by_segment(lake: Lake, start: str | None = None, end: str | None = None) -> DataFrame:
    """The same figures over [start, end) for five segmentations at once; events of unknown merchants leave the mcc
    segmentation."""
    banded = within(lake.scored_events, start, end).select(
        "auth_event_id", "merchant_id", "merchant_country_code", "channel", "auth_type", "billing_amount_usd",
        "auth_amount", "risk_band")
    mcc = lake.merchants.select("merchant_id", "mcc")
    decided = _decided(lake, banded).join(mcc, "merchant_id", "left")
    pairs = []
    for name, column in (("country", "merchant_country_code"), ("channel", "channel"), ("auth_type", "auth_type"),
                         ("mcc", "mcc"), ("risk_band", "risk_band")):
        pairs += [F.lit(name), F.col(column)]
    long = decided.select("*", F.stack(F.lit(5), *pairs).alias("segment_by", "segment_value")).where(
        (F.col("segment_by") != "mcc") | F.col("segment_value").isNotNull()
    ).withColumn("segment_value", F.coalesce("segment_value", F.lit("_unknown")))
    return business_metrics(long, ["segment_by", "segment_value"])


def scored_labelled(lake: Lake) -> DataFrame:
    """Champion scores of events with their latest label (null where none): the sweep input."""
    scores = lake.model_scores.where("not shadow").select(
        "auth_event_id", "event_time", F.col("raw_probability").alias("probability"),
        first_nonzero(F.col("billing_amount_usd"), F.col("auth_amount")).alias("amount_usd"))
    return scores.join(latest_label(lake.labels).select("auth_event_id", "is_fraud"), "auth_event_id", "left")


def threshold_economics(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold: who would be declined and what that would save. Unlabelled rows count as genuine."""
    t = curves.threshold_totals(rows, thresholds)
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    declined = F.col("tp") + F.col("fp")
    return t.select(
        "threshold", ratio(F.col("fn") + F.col("tn"), total).alias("approval_rate"),
        ratio(declined, total).alias("decline_rate"),
        ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_positive_rate"),
        ratio(F.col("fn"), F.col("tp") + F.col("fn")).alias("missed_fraud_rate"),
        rnd(F.col("prevented_usd") - F.col("fp_usd") - declined * F.lit(C.REVIEW_COST_USD), 2).alias("net_savings"))


def optimize_threshold(rows: DataFrame, thresholds: list[float] = SWEEP) -> DataFrame:
    """The whole sweep with its optimum marked: best savings within the constraints, else best savings overall; the
    lowest threshold wins a tie."""
    t = curves.threshold_totals(rows, thresholds)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    cost = (F.col("missed_usd") * F.lit(C.MISSED_FRAUD_COST) + F.col("fp_usd") * F.lit(C.FALSE_POSITIVE_COST)
            + (tp + fp) * F.lit(C.REVIEW_COST_USD))
    approval, fpr = ratio(fn + tn, tp + fp + fn + tn), ratio(fp, fp + tn)
    table = t.select(
        "threshold", rnd(F.col("prevented_usd") - cost, 2).alias("net_savings_usd"),
        rnd(F.col("prevented_usd"), 2).alias("prevented_fraud_usd"), rnd(F.col("missed_usd"), 2).alias("missed_fraud_usd"),
        rnd(F.col("fp_usd"), 2).alias("fp_volume_usd"), rnd(cost, 2).alias("business_cost_usd"),
        approval.alias("approval_rate"), fpr.alias("false_positive_rate"), ratio(fn, fn + tp).alias("missed_fraud_rate"),
        ratio(tp, tp + fn).alias("fraud_caught_pct"), (tp + fp).alias("review_load"), tp, fp, fn, tn,
        ((approval >= C.MIN_APPROVAL_RATE) & (fpr <= C.MAX_FALSE_POSITIVE_RATE)).alias("meets_constraints"))
    best = table.agg(F.max_by("threshold", F.struct(
        "meets_constraints", "net_savings_usd", -F.col("threshold"))).alias("_best"))
    return table.crossJoin(F.broadcast(best)).withColumn("is_optimal", F.col("threshold") == F.col("_best")).drop("_best")


def optimize_triple(rows: DataFrame) -> DataFrame:
    """The best (decline, review, step-up) triple with enough approvals; the first candidate wins a tie."""
    triples = threshold_triples()
    cuts = sorted({t for triple in triples for t in triple})
    spark = rows.sparkSession
    position = {c: i + 1 for i, c in enumerate(cuts)}
    # Buckets between neighbouring cut points: a few dozen rows carry everything the candidates need.
    buckets = curves.threshold_buckets(rows, cuts).drop("n_fraud")
    candidates = spark.createDataFrame(
        [(i, d, r, s, position[d], position[r], position[s]) for i, (d, r, s) in enumerate(triples)],
        "i int, decline_threshold double, review_threshold double, step_up_threshold double, d int, r int, s int")
    b = F.col("bucket")
    declined = b >= F.col("d")
    review = (b >= F.col("r")) & ~declined
    step_up = (b >= F.col("s")) & ~declined & ~review
    approved = ~(declined | review | step_up)

    def total(column: str, test: Column) -> Column:
        return F.sum(F.when(test, F.col(column)).otherwise(F.lit(0))).cast("double")

    names = ["decline_threshold", "review_threshold", "step_up_threshold"]
    judged = F.broadcast(candidates).crossJoin(buckets).groupBy("i", *names).agg(
        total("fraud_usd", declined | review).alias("prevented"), total("fraud_usd", approved).alias("missed"),
        total("fraud_usd", step_up).alias("stepped"), total("legit_usd", declined | review).alias("false"),
        total("n", review).alias("reviews"), (total("n", approved) / F.sum("n")).alias("approval"))
    cost = (F.col("missed") * F.lit(C.MISSED_FRAUD_COST)
            + F.col("stepped") * F.lit(C.STEP_UP_MISS_SHARE) * F.lit(C.MISSED_FRAUD_COST)
            + F.col("false") * F.lit(C.FALSE_POSITIVE_COST) + F.col("reviews") * F.lit(C.REVIEW_COST_USD))
    ranked = judged.withColumn("net_savings_usd", rnd(F.col("prevented") - cost, 2)).where(
        F.col("approval") >= C.MIN_APPROVAL_RATE)
    best = ranked.agg(F.max_by(F.struct(*names, "net_savings_usd"), F.struct("net_savings_usd", -F.col("i"))).alias("b"))
    return best.select(
        F.coalesce("b.decline_threshold", F.lit(0.8)).alias("decline_threshold"),
        F.coalesce("b.review_threshold", F.lit(0.5)).alias("review_threshold"),
        F.coalesce("b.step_up_threshold", F.lit(0.3)).alias("step_up_threshold"), "b.net_savings_usd")


def best_threshold(lake: Lake) -> DataFrame:
    """The screen's pick: best savings of a coarse sweep over the 30 days before `as_of`."""
    since = lake.as_of - F.make_dt_interval(F.lit(30))
    rows = scored_labelled(lake).where((F.col("event_time") >= since) & (F.col("event_time") < lake.as_of))
    return threshold_economics(rows, SCREEN_SWEEP).agg(
        F.max_by("threshold", F.struct("net_savings", -F.col("threshold"))).alias("optimal_threshold"),
        F.max("net_savings").alias("net_savings"))


def loss_curve(rows: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Cumulative fraud caught, false positives and load at each tenth of the rows of [start, end) by descending score."""
    rows = within(rows, start, end)
    return curves.top_share_totals(rows, [d / 10.0 for d in range(1, 11)]).select(
        F.col("step").alias("decile"), rnd(F.col("fraud_usd"), 2).alias("cumulative_fraud_caught_usd"),
        F.col("n_legit").alias("cumulative_false_positives"), F.col("n").alias("cumulative_review_load"))
