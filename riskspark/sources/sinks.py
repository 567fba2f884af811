"""Append-only outputs. There is no overwrite: audit and lifecycle logs only grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def append(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = rows.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever file system it names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
