"""The corpus: one entry per distinct cleaned text, and its counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_texts(cleaned: DataFrame) -> DataFrame:
    """Keep the first post, in `seq` order, of every distinct `clean` text.

    A grouped minimum instead of a ranking window: copies collapse on the map side, so a text
    that makes up a third of all posts costs one row per task in the shuffle. The hash leads the
    grouping key only to make comparisons cheap; equality is still on the text itself.
    """
    carried = [c for c in cleaned.columns if c not in ("seq", "clean", "words")]
    first = F.min(F.struct("seq", *carried)).alias("first")
    return (
        cleaned.groupBy(F.xxhash64("clean").alias("_hash"), "clean")
        .agg(first)
        .select("clean", "first.*")
    )


def word_counts(words: DataFrame, min_count: int = 1, column: str = "words") -> DataFrame:
    """(word, count) over an array column."""
    return (
        words.select(F.explode(column).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("count"))
        .filter(F.col("count") >= min_count)
    )


def metric(df: DataFrame, name: str, value=None) -> DataFrame:
    """One row (metric, value)."""
    value = F.count("*") if value is None else value
    return df.agg(value.cast("long").alias("value")).select(F.lit(name).alias("metric"), "value")
