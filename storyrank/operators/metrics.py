"""Counts taken on a pass that runs anyway."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from storyrank.sources.scratch import stored


def stored_with_counts(df: DataFrame, name: str, counts: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """`df` written to scratch, and what was counted while it was written."""
    if not counts:
        return stored(df, name), {}
    seen = Observation(name)
    table = stored(df.observe(seen, *[F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in counts.items()]), name)
    return table, dict(seen.get)


def metric_rows(spark, counts: dict[str, int]) -> DataFrame:
    """(metric, value)."""
    return spark.createDataFrame(sorted(counts.items()), "metric string, value long")
