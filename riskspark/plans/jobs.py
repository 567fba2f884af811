"""Nightly jobs as functions of a run date; each can be repeated without adding rows twice."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import constants as C
from riskspark.plans import economics, evaluation
from riskspark.plans.features import event_features
from riskspark.plans.lake import Lake
from riskspark.sources import sinks


def _midnight(day: str, days_back: int = 0) -> Column:
    return F.lit(day).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days_back))


def offline_features(lake: Lake, cutoff: str) -> DataFrame:
    """The 19 features recomputed from history before a cut-off: later events and chargebacks are not seen."""
    end = F.lit(cutoff).cast("timestamp_ntz")
    return event_features(
        lake.auth_events.where(F.col("event_time") < end),
        lake.chargebacks.where(F.col("chargeback_received_at") < end),
        lake.customers, lake.devices, lake.ips, lake.gazetteer)


def offline_training(lake: Lake, run_date: str) -> DataFrame:
    """What the offline store has for the drift job of a date: features recomputed from the history before the last 30 days."""
    start = datetime.date.fromisoformat(run_date) - datetime.timedelta(days=30)
    return offline_features(lake, f"{start} 00:00:00")


def existing_offline(lake: Lake, snapshot_date: str) -> DataFrame:
    """Rows an earlier run of the test data has already written."""
    return lake.auth_events.where(F.col("auth_event_id") % 7 == 0).select(
        "auth_event_id", F.lit(snapshot_date).cast("date").alias("label_snapshot_date"))


def backfill(lake: Lake, snapshot_date: str, existing: DataFrame) -> DataFrame:
    """The feature rows of events from before the day ahead of the snapshot that have no offline row for it yet."""
    rows = lake.feature_events.where(F.col("event_time") < _midnight(snapshot_date, 1)).select(
        "auth_event_id", F.col("event_time").alias("as_of_time"), F.lit(C.FEATURE_VERSION).alias("feature_version"),
        F.lit(snapshot_date).cast("date").alias("label_snapshot_date"), *C.FEATURES)
    return rows.join(existing, ["auth_event_id", "label_snapshot_date"], "left_anti")


def existing_snapshots(lake: Lake, snapshot_date: str) -> DataFrame:
    return lake.auth_events.where(F.col("auth_event_id") % 9 == 0).select(
        "auth_event_id", F.lit(snapshot_date).cast("date").alias("snapshot_date"))


def label_snapshot(lake: Lake, snapshot_date: str, maturity_days: int, existing: DataFrame) -> DataFrame:
    """The latest label known at the snapshot of every event older than the maturity, unless snapshotted already."""
    events = lake.auth_events.where(F.col("event_time") < _midnight(snapshot_date, maturity_days)).select("auth_event_id")
    labels = economics.latest_label(lake.labels, _midnight(snapshot_date))
    return events.join(labels, "auth_event_id").select(
        "auth_event_id", F.lit(snapshot_date).cast("date").alias("snapshot_date"),
        F.col("label_source").alias("label_status"), F.col("is_fraud").alias("is_fraud_snapshot"),
        F.lit(maturity_days).alias("maturity_days"),
    ).join(existing, ["auth_event_id", "snapshot_date"], "left_anti")


def daily(lake: Lake, run_date: str, path: str) -> DataFrame:
    """All four jobs of one date, each appended below `path`: job and rows written. Whatever a run finds written for its
    date it leaves out, so a run that is repeated adds nothing."""
    spark, day = lake.spark, F.lit(run_date).cast("date")

    def written(name: str, otherwise: DataFrame | None = None) -> DataFrame | None:
        return spark.read.parquet(f"{path}/{name}") if sinks.exists(spark, f"{path}/{name}") else otherwise

    keys = ["auth_event_id", "label_snapshot_date"]
    stored = existing_offline(lake, run_date)
    if (own := written("backfill")) is not None:
        stored = stored.unionByName(own.select(*keys))
    snapshots = existing_snapshots(lake, run_date)
    if (own := written("label_snapshot")) is not None:
        snapshots = snapshots.unionByName(own.select("auth_event_id", "snapshot_date"))
    last_day = (datetime.date.fromisoformat(run_date) - datetime.timedelta(days=1)).isoformat()
    parts = {
        "backfill": backfill(lake, run_date, stored),
        "label_snapshot": label_snapshot(lake, run_date, 7, snapshots),
        "drift": evaluation.daily_drift(offline_training(lake, run_date), lake.feature_events, run_date),
        "shadow": evaluation.shadow_experiment(lake.model_scores, start=last_day, end=run_date),
    }
    counts = []
    for name, rows in parts.items():
        dated = rows.withColumn("run_date", day)
        if (own := written(name)) is not None and name in ("drift", "shadow"):
            dated = dated.join(own.select("run_date").distinct(), "run_date", "left_anti")
        before = 0 if own is None else own.where(F.col("run_date") == day).count()
        sinks.append(dated, f"{path}/{name}")
        after = spark.read.parquet(f"{path}/{name}").where(F.col("run_date") == day).count()
        counts.append((name, after - before))
    return spark.createDataFrame(counts, "job string, rows_written long")
