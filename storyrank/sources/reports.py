"""Report and model sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyrank.functions import text

REPORT_HEADER = ("tweet", "ctime", "rt_cnt")


def write_cluster_members(members: DataFrame, path: str) -> None:
    """Folder per cluster; rows by falling distance, read file by file in name order.

    Rows are range-partitioned by the full sort key, so a cluster of any size spreads over tasks.
    """
    distance = F.round("dist", 3).desc()
    _write_ordered(members, path, [F.col("cluster"), distance, F.col("seq")])


def write_scored_posts(scored: DataFrame, path: str) -> None:
    """Folder per cluster; scored posts, best first."""
    _write_ordered(scored, path, [F.col("cluster"), F.col("score").desc(), F.col("dist_rank")])


def write_top_terms(terms: DataFrame, path: str) -> None:
    """One line per cluster: its heaviest terms in order. Ten or so terms per cluster."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    lines = terms.groupBy("cluster").agg(ordered.alias("t")).orderBy("cluster").select(
        "cluster", F.array_join(F.transform("t", lambda s: s["term"]), " ").alias("terms")
    )
    lines.write.option("header", True).csv(path)


def write_posts(posts: DataFrame, path: str, order: list[Column], ascii_text: bool = True) -> None:
    """Winners or final posts as CSV with header and quoting; a few rows, hence one file."""
    tweet = text.ascii_only(F.col("tweet")) if ascii_text else F.col("tweet")
    rows = posts.orderBy(*order).select(tweet.alias("tweet"), "ctime", "rt_cnt")
    options = {
        "header": True,
        "escape": '"',
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
    }
    rows.coalesce(1).write.options(**options).csv(path)


def report_lines(posts: DataFrame) -> DataFrame:
    """Add `line`: ASCII text, time and reposts of a post joined by a comma and a space."""
    fields = [text.ascii_only(F.col(c).cast("string")) for c in REPORT_HEADER]
    return posts.withColumn("line", text.report_line(*fields))


def save_model(model, path: str) -> None:
    """Save a fitted model; load it with `load` of its class."""
    model.write().overwrite().save(path)


def _write_ordered(df: DataFrame, path: str, order: list[Column]) -> None:
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    spread.write.partitionBy("cluster").parquet(path)
