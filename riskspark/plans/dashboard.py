"""Searches, queues and summaries behind the operations screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import constants as C
from riskspark.functions.numeric import micros, ratio, rnd
from riskspark.operators.merge import latest
from riskspark.plans.lake import Lake
from riskspark.plans.scoring_views import cases

SEARCH_FIELDS = ["customer_id", "merchant_id", "card_id", "auth_status"]


def search(events: DataFrame, limit: int = 50, offset: int = 0, after_id: int | None = None,
           min_amount: float | None = None, max_amount: float | None = None, start=None, end=None,
           **equal) -> DataFrame:
    """A page of matching transactions, newest id first, each with the total number of matches."""
    unknown = set(equal) - set(SEARCH_FIELDS)
    if unknown:
        raise ValueError(f"unknown search fields {sorted(unknown)}")
    found = events
    for field, value in equal.items():
        if value is not None:
            found = found.where(F.col(field) == F.lit(value))
    if after_id is not None:
        found = found.where(F.col("auth_event_id") < after_id)
    if min_amount is not None:
        found = found.where(F.col("billing_amount_usd") >= F.lit(str(min_amount)).cast("decimal(18,2)"))
    if max_amount is not None:
        found = found.where(F.col("billing_amount_usd") <= F.lit(str(max_amount)).cast("decimal(18,2)"))
    if start is not None:
        found = found.where(F.col("event_time") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        found = found.where(F.col("event_time") <= F.lit(end).cast("timestamp_ntz"))
    page = found.orderBy(F.col("auth_event_id").desc()).offset(offset).limit(limit)
    total = found.agg(F.count("*").alias("total"))
    return page.crossJoin(F.broadcast(total))


def search_transactions(lake: Lake) -> DataFrame:
    found = search(lake.scored_events, auth_status="review", min_amount=20, start="2024-01-05 00:00:00", offset=10)
    return found.select("auth_event_id", "customer_id", "merchant_id", "billing_amount_usd", "auth_status",
                        "event_time", "total")


def keyset_page(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows in order with the page's cursor flag: `has_more` when the page is full."""
    page = rows.orderBy(*order).limit(limit)
    full = page.agg((F.count("*") == limit).alias("has_more"))
    return page.crossJoin(F.broadcast(full))


def page_keyset(lake: Lake) -> DataFrame:
    """The page after the newest id: walk back by plain id."""
    newest = lake.auth_events.agg(F.max("auth_event_id").alias("_newest"))
    rows = lake.auth_events.crossJoin(F.broadcast(newest)).where("auth_event_id < _newest").select(
        "auth_event_id", "customer_id", "auth_amount", "event_time")
    page = keyset_page(rows, [F.col("auth_event_id").desc()], 50)
    last = page.agg(F.min("auth_event_id").alias("next_cursor"))
    return page.crossJoin(F.broadcast(last))


def audit_trail(rows: DataFrame, entity_type: str | None = None, entity_id: str | None = None, limit: int = 100,
                after_id: int | None = None) -> DataFrame:
    if entity_type is not None:
        rows = rows.where(F.col("entity_type") == entity_type)
    if entity_id is not None:
        rows = rows.where(F.col("entity_id") == entity_id)
    if after_id is not None:
        rows = rows.where(F.col("audit_id") < after_id)
    return rows.orderBy(F.col("created_at").desc(), F.col("audit_id").desc()).limit(limit)


def agent_traces(traces: DataFrame) -> DataFrame:
    """All steps, sorted within each case by a range sort on (case, step)."""
    return traces.orderBy("case_id", "step_index").select(
        "case_id", "step_index", "step_type", F.length("output").alias("output_length"))


def features_get(features: DataFrame, requested: DataFrame) -> DataFrame:
    """Feature rows of the requested events."""
    return features.join(requested.select("auth_event_id").distinct(), "auth_event_id", "left_semi").select(
        "auth_event_id", *C.FEATURES)


def review_actions(lake: Lake) -> DataFrame:
    """Reviews arrive with the labels of case events."""
    return lake.labels.select(
        F.col("auth_event_id").alias("case_id"), F.col("label_received_at").alias("action_time"),
        F.col("label_id").alias("action_id"), F.col("label_source").alias("reviewer_id"),
        F.when(F.col("is_fraud"), "resolved_fraud").otherwise("resolved_not_fraud").alias("decision"))


def review_cases(case_rows: DataFrame, actions: DataFrame) -> DataFrame:
    """Cases after their latest review: status, update time, closing time and the number of reviews."""
    last = latest(actions, ["case_id"], ["action_time", "action_id"], ["decision", "action_time", "reviewer_id"])
    counted = actions.groupBy("case_id").agg(F.count("*").alias("n_reviews"))
    closing = F.col("decision").isin(C.CLOSING_STATUSES)
    return case_rows.join(last, "case_id", "left").join(counted, "case_id", "left").select(
        "case_id", F.coalesce("decision", "case_status").alias("case_status"),
        F.col("action_time").alias("updated_at"), F.when(closing, F.col("action_time")).alias("closed_at"),
        "reviewer_id", F.coalesce("n_reviews", F.lit(0)).alias("n_reviews"))


def create_cases(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Open cases from requests (event, reason, time) that have none yet, with the default queue and priority."""
    return requests.join(existing, "auth_event_id", "left_anti").select(
        F.col("auth_event_id").alias("case_id"), "auth_event_id", F.lit("open").alias("case_status"),
        F.lit("general").alias("queue_name"), F.lit("medium").alias("priority"), "created_reason",
        F.col("requested_at").alias("created_at"))


def case_create(lake: Lake) -> DataFrame:
    requests = lake.chargebacks.select(
        "auth_event_id", F.lit("chargeback").alias("created_reason"),
        F.col("chargeback_received_at").alias("requested_at"))
    return create_cases(requests, cases(lake.scored_events).select("auth_event_id"))


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "critical", 0).when(priority == "high", 1).otherwise(2)


def case_queue(case_rows: DataFrame, status: str = "open", queue: str | None = None, limit: int = 50,
               after: tuple | None = None) -> DataFrame:
    """Critical first, then high, then oldest. `after` = (rank, created_at, id) of the last row of the page before."""
    rows = case_rows.where(F.col("case_status") == status).withColumn("rank", priority_rank(F.col("priority")))
    if queue is not None:
        rows = rows.where(F.col("queue_name") == queue)
    if after is not None:
        rank, created, case = after
        rows = rows.where(
            F.struct("rank", "created_at", "case_id")
            > F.struct(F.lit(rank), F.lit(created).cast("timestamp_ntz"), F.lit(case).cast("bigint")))
    return rows.orderBy("rank", "created_at", "case_id").limit(limit).select(
        "case_id", "queue_name", "priority", "created_at", "rank")


def queue_summary(case_rows: DataFrame) -> DataFrame:
    """Cases per queue by status; `other` counts every status besides the three, and `total` all rows."""
    named = ("open", "in_progress", "closed")
    counts = [F.count_if(F.col("case_status") == s).alias(s) for s in named]
    return case_rows.groupBy("queue_name").agg(*counts, F.count("*").alias("total")).withColumn(
        "other", F.col("total") - F.col("open") - F.col("in_progress") - F.col("closed"))


def queue_age(case_rows: DataFrame, as_of: Column) -> DataFrame:
    age = (micros(as_of) - micros(F.col("created_at"))).cast("decimal(20,0)")
    live = F.col("case_status").isin("open", "in_progress")
    hours = F.lit(3.6e9)
    return case_rows.groupBy("queue_name").agg(
        F.count_if(F.col("case_status") == "open").alias("open_count"),
        F.count_if(F.col("case_status") == "in_progress").alias("in_progress_count"),
        rnd(F.sum(F.when(live, age)).cast("double") / F.count_if(live) / hours, 4).alias("avg_age_hours"),
        rnd(F.max(F.when(live, age)).cast("double") / hours, 4).alias("oldest_case_hours"))


def ops_summary(lake: Lake) -> DataFrame:
    """Key figures of the 24 hours before `as_of`: five one-row aggregates side by side."""
    since = lake.as_of - F.make_dt_interval(F.lit(1))
    scored, decided = lake.scored_events, F.col("event_time") >= since
    figures = scored.where(decided).agg(
        F.count("*").alias("total_transactions"),
        F.count_if(F.col("decision").isin("decline", "hard_decline")).alias("total_declines"),
        F.count_if(F.col("decision") == "manual_review").alias("total_reviews"))
    fraud = lake.labels.where((F.col("label_received_at") >= since) & F.col("is_fraud")).agg(
        F.count("*").alias("confirmed_fraud"))
    waiting = cases(scored).where(F.col("case_status").isin("open", "in_progress")).agg(
        F.count("*").alias("open_cases"))
    total = F.greatest("total_transactions", F.lit(1))
    return figures.crossJoin(fraud).crossJoin(waiting).withColumns({
        "decline_rate": ratio(F.col("total_declines"), total), "review_rate": ratio(F.col("total_reviews"), total)})


def recent_decisions(scored: DataFrame, limit: int = 10) -> DataFrame:
    return scored.orderBy(F.col("auth_event_id").desc()).limit(limit).select(
        "auth_event_id", "customer_id", "billing_amount_usd", "decision", "risk_band", "final_score")
