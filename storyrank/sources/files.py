"""Names in the folders that Spark reads and writes, on any of its file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _located(spark, path)
    return system.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none when it is not there."""
    system, where = _located(spark, path)
    if not system.exists(where):
        return []
    return [status.getPath().getName() for status in system.listStatus(where)]


def count(spark: SparkSession, path: str) -> int:
    """Files in a folder; none when it is not there."""
    system, where = _located(spark, path)
    return system.getContentSummary(where).getFileCount() if system.exists(where) else 0


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder; whether it was there."""
    system, where = _located(spark, path)
    return system.delete(where, True)


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path as tasks may open it by themselves; None when it is not on a mounted file system."""
    system, where = _located(spark, path)
    place = system.makeQualified(where).toUri()
    return place.getPath() if place.getScheme() == "file" else None
