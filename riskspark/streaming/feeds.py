"""Structured Streaming jobs over a Parquet feed. Every job runs with `availableNow`: it takes what has arrived since
its checkpoint and stops, so a scheduler may call it as often as results are wanted.

Per-event features need exact look-back windows. They are computed in `foreachBatch` from the new events and the part
of the event log that their entities have, with the same operators as the batch job: these split hot keys into time
slices, which a per-key state could not. The log itself is the state; a repeated batch overwrites its own part of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from riskspark.functions import scoring as S
from riskspark.operators import contracts
from riskspark.operators.merge import latest
from riskspark.plans.lake import Lake
from riskspark.session import checkpoint_dir
from riskspark.sources import sinks, tables

LATENESS = "2 days"
LABEL_HORIZON_DAYS = 120


def run_folder(spark: SparkSession) -> str:
    """A new folder for one run's checkpoint and output."""
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def read_feed(spark: SparkSession, folder: str, files_per_batch: int | None = None,
              pattern: str = "events*.parquet") -> DataFrame:
    """The raw event feed as a stream, under its declared schema."""
    reader = spark.readStream.schema(tables.SCHEMAS["events"]).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def timed(events: DataFrame, column: str = "event_time", delay: str = LATENESS) -> DataFrame:
    """Event time as an instant with its watermark."""
    return events.withColumn("event_ts", F.col(column).cast("timestamp")).withWatermark("event_ts", delay)


def run(stream: DataFrame, write: Callable[[DataFrame, int], None], path: str, mode: str = "append") -> StreamingQuery:
    """Process everything available through `foreachBatch`, then stop."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(
        availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query


def _store(rows: DataFrame, path: str, batch: int, by: str | None = None) -> None:
    """One batch owns one folder, so a batch that runs again replaces its rows; within it, a folder per value of `by`."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(f"{path}/batch={batch}")


@contextmanager
def _intake(spark: SparkSession, batch: DataFrame, path: str, number: int, delay: str) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(rows to apply, late rows) of a batch, cached while the context lasts, and a record of it under `path/progress`.

    A row is late if it is older than the newest event of all earlier batches by more than `delay`. Late rows are returned,
    not dropped, so each has a place in some output. A row to apply is the first with its id: repeats in the batch, and
    repeats of rows that earlier batches applied inside the delay, are left out and counted. The record is written by the
    sink with the batch, so a repeated batch replaces it and no count depends on what the progress listener still holds.
    """
    progress, ids = f"{path}/progress", f"{path}/ids"
    mark = None
    if number > 0 and sinks.exists(spark, progress):
        mark = spark.read.schema("newest timestamp_ntz, rows long, applied long, late long, batch int").parquet(
            progress).where(F.col("batch") < number).agg(F.max("newest")).first()[0]
    behind = F.lit(False) if mark is None else F.coalesce(
        F.col("event_time") < F.lit(mark).cast("timestamp_ntz") - F.expr(f"interval {delay}"), F.lit(False))
    marked = batch.withColumn("_late", behind).persist()
    late = marked.where("_late").drop("_late")
    first = Window.partitionBy("auth_event_id").orderBy("event_time")
    fresh = marked.where("not _late").drop("_late").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    if mark is not None:
        # Only the days that repeats can lie in are read.
        since = F.lit(mark).cast("timestamp_ntz") - F.expr(f"interval {delay}")
        applied = spark.read.schema("auth_event_id long, event_time timestamp_ntz, batch int, event_date date").parquet(ids).where(
            (F.col("batch") < number) & (F.col("event_date") >= F.to_date(since)) & (F.col("event_time") >= since))
        fresh = fresh.join(applied.select("auth_event_id"), "auth_event_id", "left_anti")
    _store(fresh.select("auth_event_id", "event_time", F.to_date("event_time").alias("event_date")), ids, number, "event_date")
    record = marked.agg(F.max("event_time").alias("newest"), F.count("*").alias("rows"), F.count_if("_late").alias("late"))
    count = spark.read.schema("auth_event_id long").parquet(f"{ids}/batch={number}").agg(F.count("*").alias("applied"))
    _store(record.crossJoin(count).select("newest", "rows", "applied", "late"), progress, number)
    try:
        yield fresh, late
    finally:
        marked.unpersist()


def ingest(spark: SparkSession, folder: str, path: str, files_per_batch: int | None = None,
           delay: str = LATENESS) -> StreamingQuery:
    """Check each event once and split the feed into valid and quarantined rows; late rows are quarantined as such."""
    raw = tables.auth_events(read_feed(spark, folder, files_per_batch)).withColumn(
        "entry_mode", F.lit(None).cast("string"))

    def write(batch: DataFrame, number: int) -> None:
        with _intake(spark, batch, path, number, delay) as (fresh, late):
            checked = contracts.validate(fresh, contracts.AUTH_EVENT).persist()
            _store(checked.where("valid").drop("errors", "valid"), f"{path}/valid", number)
            held = late.withColumns({"errors": F.array(F.lit(f"late: more than {delay} behind")), "valid": F.lit(False)})
            _store(checked.where("not valid").unionByName(held), f"{path}/quarantine", number)
            checked.unpersist()

    return run(raw, write, path)


def ingested(lake: Lake) -> DataFrame:
    """Rows of the valid and the quarantined output."""
    path = run_folder(lake.spark)
    ingest(lake.spark, lake.folder, path)
    valid = lake.spark.read.parquet(f"{path}/valid").select("auth_event_id", F.lit("").alias("errors"))
    held = lake.spark.read.parquet(f"{path}/quarantine").select(
        "auth_event_id", F.array_join("errors", "; ").alias("errors"))
    return valid.unionByName(held)


ENTITIES = ["customer_id", "card_id", "merchant_id", "device_id", "ip_address"]


def _history(past: DataFrame, new: DataFrame, chargebacks: DataFrame, horizon_days: int) -> DataFrame:
    """The rows of the log that features of the new events can depend on.

    Inside the longest window: the rows that share an entity with a new event. Before it: per customer of the batch the
    last event and the last event with an address, for the distance and the gap to the previous event, however long ago;
    and the authorizations of a merchant's chargebacks, which count from receipt, not from the authorization.
    """
    oldest = new.agg(F.min("event_time")).first()[0]
    cut = F.to_date(F.lit(oldest).cast("timestamp_ntz") - F.make_dt_interval(F.lit(horizon_days)))
    recent, older = past.where(F.col("event_date") >= cut), past.where(F.col("event_date") < cut)
    parts = [recent.join(new.select(c).distinct(), c, "left_semi") for c in ENTITIES]
    mine = older.join(new.select("customer_id").distinct(), "customer_id", "left_semi")
    parts += [latest(rows, ["customer_id"], ["event_time", "auth_event_id"], [c for c in past.columns if c != "customer_id"])
              .select(*past.columns) for rows in (mine, mine.where("ip_address is not null"))]
    parts.append(older.join(chargebacks.select("auth_event_id").distinct(), "auth_event_id", "left_semi").join(
        new.select("merchant_id").distinct(), "merchant_id", "left_semi"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates(["auth_event_id"])


def score(lake: Lake, path: str, files_per_batch: int | None = None, folder: str | None = None,
          delay: str = LATENESS) -> StreamingQuery:
    """Score the feed: features of the new events over the log, rules, model and decision, appended per batch.

    A batch reads only the part of the log that its own entities have; the log keeps all rows. Late rows are kept and
    counted under `path/late`, and are not scored: their time has been scored without them.
    """
    from riskspark.plans.decisions import score_events
    from riskspark.plans.features import P95_HORIZON, event_features

    spark = lake.spark
    raw = tables.normalized_events(tables.auth_events(read_feed(spark, folder or lake.folder, files_per_batch)))
    log = f"{path}/log"

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        with _intake(spark, batch, path, number, delay) as (fresh, late):
            _store(late, f"{path}/late", number)
            fields = fresh.schema.fields
            _store(fresh.withColumn("event_date", F.to_date("event_time")), log, number, "event_date")
        schema = StructType([*fields, StructField("event_date", DateType())])
        new = spark.read.schema(schema).parquet(f"{log}/batch={number}").drop("event_date")
        if new.isEmpty():
            return
        logged = spark.read.schema(schema.add("batch", IntegerType())).parquet(log).where(F.col("batch") < number).drop("batch")
        chargebacks = lake.chargebacks
        past = _history(logged, new, chargebacks, P95_HORIZON // 86_400_000_000).drop("event_date")
        features = event_features(past.unionByName(new), chargebacks, lake.customers, lake.devices, lake.ips, lake.gazetteer)
        mine = features.join(new.select("auth_event_id"), "auth_event_id", "left_semi")
        _store(score_events(mine), f"{path}/scored", number)

    return run(raw, write, path)


def scored(lake: Lake) -> DataFrame:
    path = run_folder(lake.spark)
    score(lake, path)
    return lake.spark.read.parquet(f"{path}/scored").drop("batch")


def _latest_windows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Update mode writes a window each time it changes: keep the last write of each."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r")).select(*keys, "r.*")


def windowed(spark: SparkSession, totals: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Run a windowed aggregation in update mode and read back the final value of every window."""
    shaped = totals.withColumn("window_start", F.col("window.start").cast("timestamp_ntz")).drop("window")
    run(shaped, lambda batch, number: _store(batch, f"{path}/windows", number), path, mode="update")
    return _latest_windows(spark, f"{path}/windows", ["window_start", *keys])


def ops_stream(lake: Lake, folder: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    return timed(tables.ops_metrics(read_feed(lake.spark, folder or lake.folder, files_per_batch)))


def ops_tumbling(lake: Lake) -> DataFrame:
    """Requests and errors per endpoint and hour."""
    totals = ops_stream(lake).groupBy(F.window("event_ts", "1 hour"), "endpoint").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") >= 400).alias("errors"))
    return windowed(lake.spark, totals, ["endpoint"], run_folder(lake.spark))


def ops_sliding(lake: Lake) -> DataFrame:
    """Five-minute windows each minute: throughput, fallbacks and latency quantiles."""
    totals = ops_stream(lake).groupBy(F.window("event_ts", "5 minutes", "1 minute")).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") != 200).alias("fallbacks"),
        F.percentile_approx("latency_ms", [0.5, 0.95, 0.99], 10000).alias("_q"))
    shaped = totals.select("window", "n", "fallbacks", *[
        F.col("_q")[i].alias(name) for i, name in enumerate(("p50", "p95", "p99"))])
    return windowed(lake.spark, shaped, [], run_folder(lake.spark))


def rule_topk(lake: Lake, k: int = 10) -> DataFrame:
    """The most fired rules of every hour, counted over the stream of scored events."""
    spark = lake.spark
    path = run_folder(spark)
    score(lake, path)
    feed = spark.readStream.schema(spark.read.parquet(f"{path}/scored").schema).parquet(f"{path}/scored")
    fired = timed(feed).select("event_ts", F.explode(F.transform(
        F.filter(S.rule_rows(), lambda rule: rule["fired"]), lambda rule: rule["rule_name"])).alias("rule_name"))
    totals = fired.groupBy(F.window("event_ts", "1 hour"), "rule_name").agg(F.count("*").alias("fires"))
    counts = windowed(spark, totals, ["rule_name"], f"{path}/topk")
    # At most one row per rule and hour.
    order = Window.partitionBy("window_start").orderBy(F.col("fires").desc(), "rule_name")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def label_join(lake: Lake, folder: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Authorizations joined to labels that arrive within 120 days, stream to stream; both sides' state expires."""
    spark = lake.spark
    path = run_folder(spark)
    source = folder or lake.folder
    events = tables.auth_events(read_feed(spark, source, files_per_batch)).select(
        F.col("auth_event_id").alias("event_key"), F.col("event_time").cast("timestamp").alias("event_ts"),
        "customer_id").withWatermark("event_ts", LATENESS)
    labels = tables.fraud_labels(read_feed(spark, source, files_per_batch)).select(
        "auth_event_id", "label_id", "is_fraud",
        F.col("label_received_at").cast("timestamp").alias("label_ts")).withWatermark("label_ts", LATENESS)
    joined = events.join(labels, F.expr(
        f"event_key = auth_event_id and label_ts >= event_ts "
        f"and label_ts <= event_ts + interval {LABEL_HORIZON_DAYS} days")).select(
        "auth_event_id", "customer_id", "label_id", "is_fraud",
        F.timestamp_diff("SECOND", F.col("event_ts"), F.col("label_ts")).alias("delay_seconds"))
    run(joined, lambda batch, number: _store(batch, f"{path}/joined", number), path)
    return spark.read.parquet(f"{path}/joined").drop("batch")


def late_rows(lake: Lake, folder: str | None = None, files_per_batch: int | None = None,
              delay: str = LATENESS) -> DataFrame:
    """How many events were applied and how many came too late, from the record that the sink keeps of every batch."""
    spark = lake.spark
    path = run_folder(spark)
    raw = tables.auth_events(read_feed(spark, folder or lake.folder, files_per_batch))

    def write(batch: DataFrame, number: int) -> None:
        with _intake(spark, batch, path, number, delay) as (_, late):
            _store(late, f"{path}/late", number)

    run(raw, write, path)
    return spark.read.parquet(f"{path}/progress").agg(
        F.coalesce(F.sum("applied"), F.lit(0)).alias("applied"), F.coalesce(F.sum("late"), F.lit(0)).alias("dropped"))


def velocity_sliding(lake: Lake) -> DataFrame:
    """The approximate native form: events per customer in one-hour windows that start every ten minutes."""
    events = timed(tables.auth_events(read_feed(lake.spark, lake.folder)))
    totals = events.groupBy(F.window("event_ts", "1 hour", "10 minutes"), "customer_id").agg(F.count("*").alias("n"))
    return windowed(lake.spark, totals, ["customer_id"], run_folder(lake.spark))
