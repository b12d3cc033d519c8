"""Intermediate tables in the shared scratch folder of the cluster.

Results that feed several jobs are written once and read back, so that a lost executor never
forces the whole lineage to be computed again. The folder is the one the session names in
`spark.checkpoint.dir`; only a local session without that setting gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from storyrank.sources import files

CHECKPOINT_SETTING = "spark.checkpoint.dir"

# shuffle files of a write go when it has ended, not when the driver happens to collect its garbage
SHUFFLE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# folders made for local sessions that name none, by application
_LOCAL_ROOTS: dict[str, str] = {}

# what this process has named in the scratch folder, by application
_NAMED: dict[str, list[str]] = {}

# where stored tables lie
_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_root(spark: SparkSession) -> str:
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
    if context.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="storyrank-")
    return _LOCAL_ROOTS[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _NAMED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete what this process has written to the scratch folder; tables still in use go too, so this
    is the last step of a job. Returns how many folders there were."""
    paths = _NAMED.pop(spark.sparkContext.applicationId, [])
    return sum(files.remove(spark, path) for path in paths)


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SHUFFLE_SETTING, None)
    spark.conf.set(SHUFFLE_SETTING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_SETTING)
        else:
            spark.conf.set(SHUFFLE_SETTING, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the scratch folder and return the table read back.

    A write is a plan of its own, so nothing reads its shuffle files after it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PLACES[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again; others are left alone."""
    for table in tables:
        path = _PLACES.pop(table, None)
        if path is not None:
            files.remove(table.sparkSession, path)
