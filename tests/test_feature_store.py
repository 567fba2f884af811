"""Stored feature groups: equal to computed ones, read with pruning, written again without touching other days."""

import os
import re

from pyspark.sql import functions as F

from riskspark.plans import feature_store
from riskspark.plans.lake import Lake

NAMES = ["device_risk_score", "seconds_since_last_txn", "geo_distance_from_last_txn_km"]


def files(path):
    return {(folder, name) for folder, _, names in os.walk(path) for name in names if name.endswith(".parquet")}


def test_every_feature_has_one_group():
    from riskspark.constants import FEATURES

    assert sorted(sum(feature_store.GROUPS.values(), [])) == sorted(FEATURES)


def test_stored_features(spark, tmp_path):
    lake, path = Lake.of(spark, "/root/testdata/sf0.001"), str(tmp_path / "store")
    feature_store.store(lake, path, groups=["previous", "static"])
    computed = lake.some_features(NAMES)
    as_rows = lambda rows: sorted(map(tuple, rows.select("auth_event_id", *NAMES).collect()))
    assert as_rows(feature_store.read(spark, path, NAMES)) == as_rows(computed)

    window = feature_store.read(spark, path, NAMES, "2024-01-05", "2024-01-08")
    inside = computed.where("event_time >= '2024-01-05' and event_time < '2024-01-08'")
    assert as_rows(window) == as_rows(inside) != []
    wanted = inside.limit(3).select("auth_event_id").collect() * 2 + [(None,), (-5,)]
    asked = spark.createDataFrame(wanted, "auth_event_id long")
    some = feature_store.read(spark, path, ["seconds_since_last_txn"], "2024-01-05", "2024-01-08", asked)
    assert some.count() == 3
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "static" not in plan and re.search(r"PartitionFilters: \[[^\]]*day#[^\]]*shard#", plan)
    scan = feature_store.read(spark, path, ["seconds_since_last_txn"], "2024-01-05", "2024-01-06", asked)
    assert len(scan.inputFiles()) > 0

    before = files(path)
    feature_store.store(lake, path, "2024-01-05", "2024-01-06", groups=["previous"])
    day = str((inside.select(F.min(feature_store.day_of(F.col("event_time")))).first()[0]))
    gone = before - files(path)
    assert gone and all(f"previous/day={day}/" in folder for folder, _ in gone)
    assert as_rows(feature_store.read(spark, path, NAMES)) == as_rows(computed)
