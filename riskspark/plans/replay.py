"""What a decision looked like when it was made, and what it would be under another model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import constants as C
from riskspark.functions import scoring as S
from riskspark.functions.numeric import micros, ratio, rnd
from riskspark.operators.merge import latest
from riskspark.plans import economics, intake
from riskspark.plans import scoring_views as views
from riskspark.plans.lake import Lake

CHALLENGER = C.SHADOW_VERSIONS[0]
# --- fixed values: thresholds of the what-if comparison -----------------------------------------------------------
WHAT_IF = {"decline": 0.60, "review": 0.45, "step_up": 0.30}


def nested(rows: DataFrame, key: str, order: list[str], columns: list[str], name: str) -> DataFrame:
    """One row per key with its rows as an ordered array of structs; a key here has a handful of rows."""
    ordered = F.sort_array(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))
    return rows.groupBy(key).agg(ordered.alias(name))


def transaction_360(lake: Lake) -> DataFrame:
    """Event with its scores, fired rules, latest decision, labels, lifecycle and graph score."""
    scored = lake.scored_events
    scores = nested(lake.model_scores, "auth_event_id", ["shadow", "model_version"],
                    ["fraud_probability", "calibrated_probability", "risk_band"], "scores")
    rules = nested(views.rules_long(scored).where("fired"), "auth_event_id", ["rule_id"],
                   ["rule_name", "severity", "explanation"], "fired_rules")
    labels = nested(lake.labels, "auth_event_id", ["label_received_at", "label_id"], ["is_fraud", "label_source"],
                    "labels")
    life = nested(intake.lifecycle(scored), "auth_event_id", ["step"], ["event_type", "actor_id"], "lifecycle")
    event = lake.auth_events.select(
        "auth_event_id", "transaction_id", "event_time", "customer_id", "account_id", "auth_amount", "currency_code",
        "channel", "auth_type")
    for part in (scores, rules, labels, life, economics.latest_decision(lake.decisions)):
        event = event.join(part, "auth_event_id", "left")
    graph = lake.graph_risk.select(
        F.col("account_id"), "cluster_size", F.col("hop2_risk_score").alias("graph_risk"))
    return event.join(graph, "account_id", "left")


def _joined(column: str, field: str) -> Column:
    return F.array_join(F.transform(column, lambda r: r[field].cast("string")), ",")


def transaction_360_text(lake: Lake) -> DataFrame:
    """The 360 view with its arrays as comma lists, for comparison and export."""
    return transaction_360(lake).select(
        "auth_event_id", "customer_id", "auth_amount", F.coalesce(F.size("scores"), F.lit(0)).alias("n_scores"),
        _joined("scores", "risk_band").alias("bands"), _joined("fired_rules", "rule_id").alias("fired_rules"),
        "decision_type", _joined("labels", "label_source").alias("labels"),
        _joined("lifecycle", "event_type").alias("lifecycle"), "cluster_size", "graph_risk")


def label_span(labels: DataFrame) -> DataFrame:
    """First and last label of every event by receipt."""
    order = ["label_received_at", "label_id"]
    first = latest(labels, ["auth_event_id"], order, ["label_received_at"], first=True).withColumnRenamed(
        "label_received_at", "first_received_at")
    last = latest(labels, ["auth_event_id"], order, ["is_fraud", "label_received_at"]).withColumnRenamed(
        "label_received_at", "last_received_at")
    return first.join(last, "auth_event_id")


def decision_correct(decision: Column, is_fraud: Column) -> Column:
    """Against the latest label: fraud must not have been let through, a genuine event must have been."""
    passed = decision.isin("approve", "step_up")
    return F.when(decision.isNotNull() & is_fraud.isNotNull(), F.when(is_fraud, ~passed).otherwise(passed))


def replay_table(lake: Lake) -> DataFrame:
    """Everything a replay needs, one row per event: features, scores, latest decision, labels."""
    return (
        lake.scored_events
        .join(economics.latest_decision(lake.decisions), "auth_event_id", "left")
        .join(label_span(lake.labels), "auth_event_id", "left")
        .withColumn("decision_correct", decision_correct(F.col("decision_type"), F.col("is_fraud")))
        .withColumn("time_to_label_seconds", rnd(
            (micros(F.col("first_received_at")) - micros(F.col("event_time"))) / F.lit(1e6), 3))
    )


def replay_decisions(lake: Lake) -> DataFrame:
    """The reconstruction of every decision: payload, features, scores, rules, thresholds, labels, steps, verdict."""
    steps = lake.traces.groupBy(F.col("case_id").alias("auth_event_id")).agg(F.count("*").alias("n_traces"))
    table = replay_table(lake)
    fired = F.filter(S.rule_rows(), lambda rule: rule["fired"])
    return table.join(steps, "auth_event_id", "left").select(
        "auth_event_id",
        F.struct("transaction_id", "customer_id", "account_id", "card_id", "merchant_id", "auth_amount",
                 "currency_code").alias("payload"),
        F.struct(*C.FEATURES).alias("features"), "calibrated_probability", "risk_band",
        F.transform(fired, lambda rule: rule["rule_id"]).alias("rules_fired"),
        F.struct(F.lit(C.THRESHOLD_DECLINE).alias("decline"), F.lit(C.THRESHOLD_REVIEW).alias("review"),
                 F.lit(C.THRESHOLD_STEP_UP).alias("step_up")).alias("thresholds"),
        "decision_type", "is_fraud", "decision_correct", "time_to_label_seconds",
        F.coalesce("n_traces", F.lit(0)).alias("n_traces"))


def replay_decisions_text(lake: Lake) -> DataFrame:
    return replay_decisions(lake).select(
        "auth_event_id", "payload.customer_id", "payload.auth_amount", "features.customer_spend_24h",
        "features.seconds_since_last_txn", "calibrated_probability", "risk_band",
        F.array_join("rules_fired", ",").alias("rules_fired"),
        F.col("thresholds.review").alias("threshold_review"), "decision_type", "is_fraud", "decision_correct",
        "time_to_label_seconds", "n_traces")


def what_if(table: DataFrame, version: str, decline: float, review: float, step_up: float) -> DataFrame:
    """Re-score with another model and thresholds. `what_if_decision` ignores rules; `blend_decision` keeps them."""
    probability = S.calibrate_sigmoid(S.heuristic_score(F.lit(version)))
    scored = table.withColumn("what_if_probability", probability)
    blended = S.blend(F.col("what_if_probability"), F.col("rule_score"))
    return scored.withColumns({
        "what_if_decision": S.decide_by_probability(F.col("what_if_probability"), decline, review, step_up),
        "blend_decision": F.when(blended >= decline, "hard_decline")
        .when((blended >= review) | F.col("high_rule_fired"), "manual_review")
        .when(blended >= step_up, "step_up").otherwise("approve"),
    }).withColumns({"decision_changed": ~F.col("what_if_decision").eqNullSafe(F.col("decision_type")),
                    "what_if_probability": rnd(F.col("what_if_probability"), 6)})


def replay_compare(lake: Lake) -> DataFrame:
    return what_if(replay_table(lake), CHALLENGER, **WHAT_IF).select(
        "auth_event_id", F.col("decision_type").alias("actual_decision"), "what_if_probability", "what_if_decision",
        "blend_decision", "decision_changed")


def replay_batch(lake: Lake, version: str = CHALLENGER) -> DataFrame:
    """All decisions under one model: how many change, the new mix, and the confusion against the labels."""
    rows = what_if(replay_table(lake), version, C.THRESHOLD_DECLINE, C.THRESHOLD_REVIEW, C.THRESHOLD_STEP_UP)
    flagged, fraud = F.col("what_if_decision") != "approve", F.col("is_fraud")
    sums = rows.agg(
        F.count("*").alias("total_replayed"), F.count("decision_type").alias("total_with_actual_decision"),
        F.count_if(F.col("decision_type") != F.col("what_if_decision")).alias("decisions_changed"),
        F.count("is_fraud").alias("total_with_label"), F.count_if(~flagged).alias("would_approve_count"),
        F.count_if(F.col("what_if_decision") == "hard_decline").alias("would_decline_count"),
        F.count_if(F.col("what_if_decision").isin("manual_review", "step_up")).alias("would_review_count"),
        F.count_if(fraud & flagged).alias("true_positives"), F.count_if(~fraud & flagged).alias("false_positives"),
        F.count_if(~fraud & ~flagged).alias("true_negatives"), F.count_if(fraud & ~flagged).alias("false_negatives"))
    tp, fp, tn, fn = (F.col(c) for c in ("true_positives", "false_positives", "true_negatives", "false_negatives"))
    return sums.withColumns({
        "approval_rate": ratio(F.col("would_approve_count"), F.col("total_replayed")),
        "fpr": F.when(fp + tn > 0, ratio(fp, fp + tn)), "fnr": F.when(fn + tp > 0, ratio(fn, fn + tp))})


def risk_summary(lake: Lake) -> DataFrame:
    """Per event: champion probability, band, decision and explained factors."""
    decision = economics.latest_decision(lake.decisions).select("auth_event_id", "decision_type")
    reasons = lake.scored_events.select(
        "auth_event_id", F.array_join("reason_codes", ",").alias("reason_codes"),
        F.array_join(S.reason_texts(F.col("reason_codes")), " | ").alias("risk_factors"))
    return views.champion_scores(lake.model_scores).join(reasons, "auth_event_id").join(
        decision, "auth_event_id", "left").select(
        "auth_event_id", "model_version", "calibrated_probability", "risk_band",
        F.coalesce("decision_type", F.lit("unknown")).alias("decision"), "reason_codes", "risk_factors")


def gather_context(lake: Lake) -> DataFrame:
    """Per case what is known about its event."""
    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("auth_event_id").agg(F.count("*").alias(name))

    case_rows = views.cases(lake.scored_events).select("case_id", "auth_event_id")
    for rows, name in ((lake.auth_events, "n_transactions"), (lake.model_scores, "score_count"),
                       (lake.decisions, "n_decisions"), (lake.labels, "label_count")):
        case_rows = case_rows.join(counted(rows, name), "auth_event_id", "left")
    return case_rows.select(
        "case_id", F.col("n_transactions").isNotNull().alias("has_transaction"),
        F.coalesce("score_count", F.lit(0)).alias("score_count"),
        F.col("n_decisions").isNotNull().alias("has_decision"), F.coalesce("label_count", F.lit(0)).alias("label_count"))
