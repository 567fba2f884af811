"""Streams over several files: same answers as the batch jobs, late events counted and left out."""

import time

import pytest
from pyspark.sql import functions as F

from compare import spark_rows
from riskspark.constants import FEATURES
from riskspark.streaming import feeds


@pytest.fixture(scope="module")
def weekly(lake, tmp_path_factory):
    """The event table as four files in time order."""
    folder = str(tmp_path_factory.mktemp("weekly"))
    part = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3))
    for i in range(4):
        lake.events.where(part == i).coalesce(1).write.mode("append").parquet(f"{folder}/raw{i}")
    import glob
    import shutil

    feed = tmp_path_factory.mktemp("feed")
    for i in range(4):
        for j, path in enumerate(sorted(glob.glob(f"{folder}/raw{i}/*.parquet"))):
            shutil.copy(path, feed / f"events-{i}-{j}.parquet")
        time.sleep(1.1)
    return str(feed)


def test_scores_equal_the_batch(lake, weekly, tmp_path):
    feeds.score(lake, str(tmp_path), files_per_batch=1, folder=weekly)
    out = lake.spark.read.parquet(f"{tmp_path}/scored")
    assert out.select("batch").distinct().count() == 4
    columns = ["auth_event_id", *FEATURES, "final_score", "decision"]
    streamed, batch = spark_rows(out.select(*columns)), spark_rows(lake.scored_events.select(*columns))
    assert sorted(streamed[1], key=str) == sorted(batch[1], key=str)


def test_restart_adds_nothing(lake, weekly, tmp_path):
    for _ in range(2):
        feeds.ingest(lake.spark, weekly, str(tmp_path), files_per_batch=2)
    n = sum(lake.spark.read.parquet(f"{tmp_path}/{kind}").count() for kind in ("valid", "quarantine"))
    assert n == lake.events.count()


def test_windows_over_several_batches(lake, weekly):
    stream = feeds.ops_stream(lake, weekly, files_per_batch=1).groupBy(F.window("event_ts", "1 hour"), "endpoint").agg(
        F.count("*").alias("n"))
    got = feeds.windowed(lake.spark, stream, ["endpoint"], feeds.run_folder(lake.spark))
    want = lake.ops_metrics.groupBy(F.date_trunc("hour", "event_time").alias("w"), "endpoint").agg(F.count("*").alias("n"))
    assert got.agg(F.sum("n")).first()[0] == lake.events.count() and got.count() == want.count()


def test_label_join_over_several_batches(lake, weekly):
    assert feeds.label_join(lake, weekly, files_per_batch=1).count() == lake.labels.count()


def test_late_events_are_counted(lake, weekly, tmp_path):
    """An extra last file repeats old events under new ids: all of them come behind the watermark."""
    import glob
    import shutil

    for path in glob.glob(f"{weekly}/*.parquet"):
        shutil.copy2(path, tmp_path)
    old = lake.events.where(F.dayofmonth("ts") <= 3).withColumn("event_id", F.col("event_id") + 10**9)
    old.coalesce(1).write.parquet(f"{tmp_path}/raw")
    time.sleep(1.1)
    for path in glob.glob(f"{tmp_path}/raw/*.parquet"):
        shutil.copy(path, tmp_path / "events-late.parquet")
    row = feeds.late_rows(lake, str(tmp_path), files_per_batch=1).first()
    assert (row.applied, row.dropped) == (lake.events.count(), old.count())


def test_sliding_velocity(lake):
    windows = feeds.velocity_sliding(lake)
    assert windows.agg(F.sum("n")).first()[0] == 6 * lake.events.count()


def test_long_feed_with_late_chargebacks_scores_as_in_batch(lake, tmp_path):
    """The month stretched to 200 days: previous events and authorizations lie further back than the longest window."""
    from types import SimpleNamespace

    from riskspark.plans.features import event_features
    from riskspark.sources import tables

    start = F.lit("2024-01-01").cast("timestamp_ntz")
    seconds = F.timestamp_diff("SECOND", start, F.col("ts"))
    stretched = lake.events.withColumn("ts", F.timestamp_add("SECOND", (seconds * 7).cast("int"), start)).persist()
    feed = tmp_path / "feed"
    feed.mkdir()
    import glob
    import shutil

    for i in range(3):
        part = F.least(F.floor(F.datediff("ts", F.lit("2024-01-01")) / 70), F.lit(2)) == i
        stretched.where(part).coalesce(1).write.parquet(f"{tmp_path}/raw{i}")
        for source in glob.glob(f"{tmp_path}/raw{i}/*.parquet"):
            shutil.copy(source, feed / f"events-{i}.parquet")
        time.sleep(1.1)
    events = tables.normalized_events(tables.auth_events(stretched))
    chargebacks = events.where("auth_event_id % 5 = 0").select(
        "auth_event_id", (F.col("event_time") + F.make_dt_interval(F.lit(115))).alias("chargeback_received_at"))
    view = SimpleNamespace(spark=lake.spark, folder=str(feed), chargebacks=chargebacks, customers=lake.customers,
                           devices=lake.devices, ips=lake.ips, gazetteer=lake.gazetteer)
    feeds.score(view, str(tmp_path / "out"), files_per_batch=1)
    columns = ["auth_event_id", *FEATURES]
    want = event_features(events, chargebacks, lake.customers, lake.devices, lake.ips, lake.gazetteer).select(*columns)
    from riskspark.plans.decisions import score_events

    got = lake.spark.read.parquet(f"{tmp_path}/out/scored").select(*columns)
    assert got.where("merchant_chargeback_rate_30d > 0").count() > 0
    vectors = score_events(want).select(*columns)
    assert sorted(spark_rows(got)[1], key=str) == sorted(spark_rows(vectors)[1], key=str)


def test_late_events_are_quarantined(lake, weekly, tmp_path):
    import glob
    import shutil

    feed = tmp_path / "feed"
    feed.mkdir()
    for path in sorted(glob.glob(f"{weekly}/*.parquet")):
        shutil.copy2(path, feed)
    old = lake.events.where(F.dayofmonth("ts") <= 3).withColumn("event_id", F.col("event_id") + 10**9)
    old.coalesce(1).write.parquet(f"{tmp_path}/raw")
    time.sleep(1.1)
    for path in glob.glob(f"{tmp_path}/raw/*.parquet"):
        shutil.copy(path, feed / "events-late.parquet")
    feeds.ingest(lake.spark, str(feed), str(tmp_path / "out"), files_per_batch=1)
    held = lake.spark.read.parquet(f"{tmp_path}/out/quarantine").where(F.exists("errors", lambda e: e.startswith("late")))
    assert held.count() == old.count()
    rows = sum(lake.spark.read.parquet(f"{tmp_path}/out/{kind}").count() for kind in ("valid", "quarantine"))
    assert rows == lake.events.count() + old.count()
