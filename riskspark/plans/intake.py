"""Ingestion: clearing, chargeback and label records, dimension upserts, lifecycle and audit logs, contracts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.constants import FEATURES
from riskspark.operators import contracts, snapshots
from riskspark.operators.merge import latest, merge_snapshot
from riskspark.plans.lake import Lake
from riskspark.session import checkpoint_dir
from riskspark.sources import sinks


def clearing(lake: Lake) -> DataFrame:
    """Purchases clear a day later against their authorization."""
    received = lake.events.where("event_type = 'purchase'").select(
        F.col("event_id").alias("auth_event_id"),
        (F.col("ts") + F.make_dt_interval(F.lit(1))).alias("clearing_time"),
        F.col("value").cast("decimal(18,2)").alias("clearing_amount"),
        F.lit("settled").alias("settlement_status"))
    return received.join(
        lake.auth_events.select("auth_event_id", "transaction_id", "currency_code"), "auth_event_id")


def chargeback_records(chargebacks: DataFrame) -> dict[str, DataFrame]:
    """One chargeback gives three appends: the case, its lifecycle row and its audit row."""
    return {
        "case": chargebacks,
        "lifecycle": chargebacks.select(
            "auth_event_id", F.lit("chargeback_received").alias("event_type"),
            F.col("chargeback_received_at").alias("event_time"), F.lit("ingestion_service").alias("actor_id"),
            F.to_json(F.struct(F.col("chargeback_amount").cast("string").alias("amount"))).alias("payload")),
        "audit": chargebacks.select(
            F.lit("chargeback").alias("entity_type"), F.col("chargeback_id").cast("string").alias("entity_id"),
            F.lit("chargeback_ingested").alias("event_type"), F.col("chargeback_received_at").alias("event_time"),
            F.to_json(F.struct("auth_event_id")).alias("payload")),
    }


def chargeback_log(lake: Lake) -> DataFrame:
    """The three record kinds in one frame."""
    parts = chargeback_records(lake.chargebacks)
    columns = ["record", "key", "event_type", "event_time", "amount"]
    case = parts["case"].select(
        F.lit("case").alias("record"), F.col("chargeback_id").cast("string").alias("key"),
        F.lit("chargeback").alias("event_type"), F.col("chargeback_received_at").alias("event_time"),
        F.col("chargeback_amount").alias("amount"))
    none = F.lit(None).cast("decimal(18,2)").alias("amount")
    lifecycle = parts["lifecycle"].select(
        F.lit("lifecycle").alias("record"), F.col("auth_event_id").cast("string").alias("key"), "event_type",
        "event_time", none)
    audit = parts["audit"].select(
        F.lit("audit").alias("record"), F.col("entity_id").alias("key"), "event_type", "event_time", none)
    return case.unionByName(lifecycle).unionByName(audit).select(*columns)


def label_records(lake: Lake) -> DataFrame:
    """Labels with their effective date and the actor of their lifecycle row."""
    investigator = F.when(
        F.col("label_source") == "investigator_confirmed", F.concat(F.lit("inv_"), F.col("label_id") % 7))
    return lake.labels.withColumn("investigator_id", investigator).select(
        "label_id", "auth_event_id", "is_fraud", "label_source", "label_received_at",
        F.to_date("label_received_at").alias("effective_label_date"),
        F.when(F.col("investigator_id").isNotNull(), "investigator").otherwise("system").alias("actor_type"),
        F.coalesce("investigator_id", F.lit("label_service")).alias("actor_id"))


def _merged(lake: Lake, current: DataFrame, updates: DataFrame, key: str, update_only: list[str]) -> DataFrame:
    """The snapshot after a merge: written by key hash, then rewritten where updates fall."""
    path = f"{checkpoint_dir(lake.spark)}/snapshot-{uuid.uuid4().hex}"
    snapshots.write(current, path, key)
    snapshots.merge(path, updates, key, lambda stored, new: merge_snapshot(stored, new, key, update_only, {}))
    return snapshots.read(lake.spark, path).drop(snapshots.SHARD)


def upsert_customers(lake: Lake) -> DataFrame:
    """Latest KYC update per customer merged into the customer snapshot."""
    current = lake.customers.select(
        "*", F.lit("pending").alias("kyc_status"), F.lit("low").alias("risk_segment"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    arrived = lake.events.select(
        F.col("user_id").alias("customer_id"), F.col("ts").alias("updated_at"), "event_id",
        F.when(F.col("event_type") == "error", "rejected").otherwise("verified").alias("kyc_status"),
        F.when(F.col("value") > 100, "high").otherwise("low").alias("risk_segment"),
        F.lit("US").alias("home_country_code"))
    updates = latest(arrived, ["customer_id"], ["updated_at", "event_id"],
                     ["kyc_status", "risk_segment", "updated_at", "home_country_code"])
    return _merged(lake, current, updates, "customer_id", ["kyc_status", "risk_segment", "updated_at"])


def upsert_devices(lake: Lake) -> DataFrame:
    """Devices seen in the events merged into the device snapshot; new ones start at their latest sighting."""
    current = lake.devices.select(
        "*", F.lit(None).cast("string").alias("device_fingerprint"),
        F.lit(None).cast("timestamp_ntz").alias("first_seen_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_seen_at"))
    seen = lake.auth_events.where("device_id is not null").select(
        "device_id", "event_time", "auth_event_id",
        F.concat(F.lit("fp_"), F.col("auth_event_id") % 5).alias("device_fingerprint"))
    updates = latest(seen, ["device_id"], ["event_time", "auth_event_id"], ["device_fingerprint", "event_time"]).select(
        "device_id", "device_fingerprint", F.col("event_time").alias("first_seen_at"),
        F.col("event_time").alias("last_seen_at"), F.lit(False).alias("emulator_flag"),
        F.lit(False).alias("rooted_jailbroken_flag"))
    return _merged(lake, current, updates, "device_id", ["device_fingerprint", "last_seen_at"])


def lifecycle(scored: DataFrame) -> DataFrame:
    """The five ordered lifecycle rows of every scored event."""
    steps = [
        ("auth_received", "scoring_service"), ("features_built", "feature_service"), ("rules_scored", "rules_engine"),
        ("model_scored", "model_scorer")]
    rows = F.array(
        *[F.struct(F.lit(i).alias("step"), F.lit(name).alias("event_type"), F.lit(actor).alias("actor_id"))
          for i, (name, actor) in enumerate(steps)],
        F.struct(F.lit(4).alias("step"), F.col("decision").alias("event_type"),
                 F.lit("scoring_service").alias("actor_id")))
    return scored.select("auth_event_id", "transaction_id", "event_time", F.explode(rows).alias("r")).select(
        "auth_event_id", "transaction_id", "event_time", "r.step", "r.event_type", F.lit("system").alias("actor_type"),
        "r.actor_id")


def audit_events(scored: DataFrame) -> DataFrame:
    """Audit rows of decisions and of the cases they opened."""
    rows = F.array_compact(F.array(
        F.struct((F.col("auth_event_id") * 2).alias("audit_id"), F.lit("authorization").alias("entity_type"),
                 F.lit("decision_made").alias("event_type")),
        F.when(F.col("decision") == "manual_review", F.struct(
            (F.col("auth_event_id") * 2 + 1).alias("audit_id"), F.lit("case").alias("entity_type"),
            F.lit("case_created").alias("event_type")))))
    return scored.select(
        F.col("auth_event_id").cast("string").alias("entity_id"), F.col("event_time").alias("created_at"), "decision",
        F.explode(rows).alias("r")).select("r.audit_id", "r.entity_type", "entity_id", "r.event_type", "decision",
                                           "created_at")


def sink_append(lake: Lake) -> DataFrame:
    """Append the audit rows of decisions, then those of chargebacks, to one log and read it back."""
    path = f"{checkpoint_dir(lake.spark)}/audit-{uuid.uuid4().hex}"
    sinks.append(audit_events(lake.scored_events).select("entity_type", "entity_id", "event_type", "created_at"), path)
    sinks.append(chargeback_records(lake.chargebacks)["audit"].select(
        "entity_type", "entity_id", "event_type", F.col("event_time").alias("created_at")), path)
    return lake.spark.read.schema(
        "entity_type string, entity_id string, event_type string, created_at timestamp_ntz").parquet(path).groupBy(
        "entity_type", "event_type").agg(F.count("*").alias("n"))


def feature_json(features: DataFrame) -> DataFrame:
    return features.select("auth_event_id", F.to_json(F.struct(*FEATURES)).alias("feature_json"))


def json_vector(rows: DataFrame) -> DataFrame:
    """19 doubles from stored feature JSON: numbers as they are, flags as 0 or 1, anything else 0."""
    fields = F.from_json("feature_json", "map<string,string>")
    parsed = rows.select("auth_event_id", fields.alias("_f"))
    return parsed.select("auth_event_id", *[
        F.coalesce(
            F.when(F.col("_f")[name] == "true", F.lit(1.0)).otherwise(F.col("_f")[name].try_cast("double")),
            F.lit(0.0)).alias(name)
        for name in FEATURES])


def _report(checked: DataFrame) -> DataFrame:
    return checked.select("auth_event_id", "valid", F.array_join("errors", "; ").alias("errors"))


def contract_auth_event(lake: Lake) -> DataFrame:
    raw = lake.raw_auth_events.withColumn("entry_mode", F.lit(None).cast("string"))
    return _report(contracts.validate(raw, contracts.AUTH_EVENT))


def contract_feature_vector(lake: Lake) -> DataFrame:
    return _report(contracts.validate(contracts.coerce_features(feature_json(lake.feature_events)),
                                      contracts.FEATURE_VECTOR))


def contract_model_score(lake: Lake) -> DataFrame:
    scores = lake.scored_events.withColumn("latency_ms", F.lit(0))
    return _report(contracts.validate(scores, contracts.MODEL_SCORE))
