"""Session settings the jobs rely on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **settings: str) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster use the session you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("riskspark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


#: First partitions of a shuffle for each core, and the size that adaptive execution joins them to.
PARTITIONS_PER_CORE, JOINED_SIZE = 32, "16m"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every job needs. A checkpoint folder and partition sizes are set only where the cluster named none.

    Sorted timeline rows take ten times their shuffled size in memory. With few or large partitions a task's sorts spill
    from some input size on; many first partitions, joined while small, keep them within a task's share.
    """
    sizes = {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(max(
            PARTITIONS_PER_CORE * spark.sparkContext.defaultParallelism,
            int(spark.conf.get("spark.sql.shuffle.partitions")))),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": JOINED_SIZE,
    }
    for key, value in sizes.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Hash joins where the measured partitions are small enough for a local map; sort-merge beyond.
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; iterative jobs cut their lineage there."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="riskspark-checkpoint-")
        owner = os.getpid()
        atexit.register(lambda: shutil.rmtree(folder, ignore_errors=True) if os.getpid() == owner else None)
    context.setCheckpointDir(folder)
    return folder
