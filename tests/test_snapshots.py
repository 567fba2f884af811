"""Snapshots by key hash: merges rewrite what they touch, repeats change nothing."""

import os

import pytest
from pyspark.sql import functions as F

from riskspark.operators import snapshots
from riskspark.operators.merge import merge_snapshot


def files(path):
    return {(folder, name) for folder, _, names in os.walk(path) for name in names if name.endswith(".parquet")}


def combine(stored, new):
    return merge_snapshot(stored, new, "id", ["v"], {})


def test_a_merge_keeps_the_files_it_does_not_touch(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    current = spark.range(500).select("id", F.col("id").alias("v"), F.lit("old").alias("origin"))
    snapshots.write(current, path, "id")
    before = files(path)
    updates = spark.createDataFrame([(7, -7, "new"), (9_000, 1, "new"), (None, 5, "new")], "id long, v long, origin string")
    touched = snapshots.merge(path, updates, "id", combine)
    assert 1 <= len(touched) <= 2
    kept = {f for f in before if int(f[0].rsplit("=", 1)[1]) not in touched}
    after = files(path)
    assert kept <= after and len(kept) >= len(before) - 2 * len(touched) and after != before
    rows = {r.id: (r.v, r.origin) for r in snapshots.read(spark, path).collect()}
    assert rows == {i: (i, "old") for i in range(500)} | {7: (-7, "old"), 9_000: (1, "new")}
    # Again: the same rows.
    assert snapshots.merge(path, updates, "id", combine) == touched
    assert {r.id: (r.v, r.origin) for r in snapshots.read(spark, path).collect()} == rows
    assert files(path) >= kept
    # Nothing to merge: no file changes.
    now = files(path)
    assert snapshots.merge(path, updates.where("id is null"), "id", combine) == [] and files(path) == now


def test_a_merge_equals_a_whole_rewrite(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    current = spark.range(300).select("id", (F.col("id") * 2).alias("v"), F.lit("old").alias("origin"))
    snapshots.write(current, path, "id")
    for start in (0, 150, 290):
        updates = spark.range(start, start + 40).select("id", F.lit(start).cast("long").alias("v"), F.lit("new").alias("origin"))
        current = combine(current, updates)
        snapshots.merge(path, updates, "id", combine)
    order = lambda rows: sorted(map(tuple, rows.select("id", "v", "origin").collect()))
    assert order(snapshots.read(spark, path)) == order(current)


def test_reading_some_keys_reads_their_parts(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    snapshots.write(spark.range(500).select("id", F.lit(1).alias("v")), path, "id")
    keys = spark.createDataFrame([(3,), (4,), (3,), (99_999,)], "id long")
    found = snapshots.read(spark, path, keys, "id")
    assert sorted(r.id for r in found.collect()) == [3, 4]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shard" in plan.replace("PartitionFilters: [isnotnull(shard", "PartitionFilters: [shard") or "IN (" in plan


def test_a_merge_needs_a_snapshot(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        snapshots.merge(str(tmp_path / "none"), spark.range(1).withColumn("v", F.lit(1)), "id", combine)
