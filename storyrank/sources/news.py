"""The news table: parsing statuses, creating, appending and reading."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyrank import schema
from storyrank.config import LookupConfig
from storyrank.functions import text
from storyrank.operators.metrics import stored_with_counts
from storyrank.sources import files
from storyrank.sources.members import (
    MemberConfig,
    add_filters,
    buckets_for,
    id_hash,
    may_hold,
    with_part,
)
from storyrank.sources.scratch import stored

# Arrival order of landed text files; `LINE` then numbers the lines of one file split.
FILE_ARRIVAL = ("landed_at", "file", "file_start")
LINE = "_line"


def with_arrival(lines: DataFrame) -> DataFrame:
    """Add the arrival columns to lines read from files (column `value`)."""
    return lines.select(
        "value",
        F.col("_metadata.file_modification_time").alias("landed_at"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("file_start"),
    )


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """One status per line, from a folder of landed pages."""
    return with_arrival(spark.read.text(path))


def parse_status(raw: DataFrame) -> DataFrame:
    """Parse JSON column `value` into the news fields and a `reject` reason (NULL when good).

    A status must have the keys `user` and `text`, and carry the four fields that are kept. A
    present field may be null, except the id.
    """
    parsed = raw.withColumn("_status", F.from_json("value", schema.STATUS))
    no_id = F.col("_status.id_str").isNull()
    reject = text.let(
        F.json_object_keys("value"),
        lambda keys: F.when(keys.isNull(), REJECTS[0])
        .when(~_has_all(keys, schema.STATUS_MARKS), REJECTS[1])
        .when(~_has_all(keys, schema.STATUS_FIELDS), REJECTS[2])
        .when(no_id, REJECTS[3]),
    )
    return parsed.select(
        *raw.columns,
        F.col("_status.id_str").alias("id_str"),
        F.col("_status.text").alias("tweet"),
        F.col("_status.created_at").alias("ctime"),
        F.col("_status.retweet_count").try_cast("int").alias("rt_cnt"),
        text.status_time(F.col("_status.created_at")).alias("created_at"),
        reject.alias("reject"),
    )


def _has_all(keys: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(k) for k in wanted]), keys)) == 0


# what `parse_status` writes into `reject`
REJECTS = ("not a JSON object", "not a status", "missing field", "no id")


def outcome_counts() -> dict[str, Column]:
    """Lines, accepted ones and rejects by reason of a parsed table."""
    reasons = {f"rejected: {r}": F.count_if(F.col("reject") == r) for r in REJECTS}
    return {"lines": F.count("*"), "accepted": F.count_if(F.col("reject").isNull()), **reasons}


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject").isNull()).drop("reject", "value")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject").isNotNull()).select("value", "reject")


def first_versions(posts: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """First arrival of each id; repeats collapse on the map side."""
    fields = [c for c in posts.columns if c not in ("id_str", *arrival)]
    best = F.min_by(F.struct(*arrival, *fields), F.struct(*arrival)).alias("first")
    return posts.groupBy("id_str").agg(best).select("id_str", "first.*")


def unseen(
    posts: DataFrame,
    path: str,
    n_ids: int,
    cfg: LookupConfig = LookupConfig(),
    members: MemberConfig = MemberConfig(),
) -> DataFrame:
    """Posts whose id is not in the table at `path`; `n_ids` of them, each id once.

    A small load asks the membership index and reads only the parts that may hold one of its ids; of
    these only the id column. A larger one reads the ids of the whole table: with ids broadcast into
    that scan while they are few, by shuffle beyond. All ways give the same posts: an id counts as
    seen whatever its other fields.
    """
    spark = posts.sparkSession
    if n_ids <= min(members.probe_ids, cfg.max_broadcast_rows):
        hashes = posts.select(id_hash("id_str").alias("h")).toArrow()["h"].to_numpy()
        found = may_hold(spark, path, hashes, members)
        if not found:
            return posts
        ids = spark.read.schema(schema.NEWS).parquet(*found).select("id_str")
    else:
        ids = spark.read.schema(schema.NEWS).parquet(path).select("id_str")
    if n_ids <= cfg.max_broadcast_rows:
        wanted = F.broadcast(posts.select("id_str"))
        ids = F.broadcast(ids.join(wanted, "id_str", "left_semi").distinct())
    return posts.join(ids, "id_str", "left_anti")


def create_news(spark: SparkSession, path: str) -> None:
    """Create the table when it is absent; leave it alone when it exists."""
    if not files.exists(spark, path):
        empty = spark.createDataFrame([], schema.NEWS)
        empty.write.mode("ignore").parquet(f"{path.rstrip('/')}/part=none")


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """The news table with `seq`, its arrival order."""
    table = spark.read.schema(schema.NEWS).parquet(path).select(schema.NEWS.fieldNames())
    return table.withColumn("seq", F.struct("load", "position")).drop("load", "position")


def numbered_arrivals(
    rows: DataFrame, arrival: Sequence[str], load: int, files_per_load: int | None = None
) -> DataFrame:
    """Replace `arrival` and `LINE` of stored rows by `load` and a `position` in arrival order, without a sort.

    The values of `arrival` tell file splits apart: one row for each split is put in order, and the
    lines of a split are numbered already. A split takes 2^33 places, as the line numbers do. With
    `files_per_load` every so many files in that order are a load, the first of them `load`.
    """
    line = F.col(LINE).bitwiseAND((1 << 33) - 1)
    number = F.lit(load).cast("long")
    if not arrival:
        return rows.withColumn("position", F.col(LINE)).withColumn("load", number).drop(LINE)
    if files_per_load:
        in_files = Window.orderBy(*[a for a in arrival if a != "file_start"])
        number += F.floor((F.dense_rank().over(in_files) - 1) / files_per_load)
    splits = rows.select(*arrival).distinct()
    order = F.row_number().over(Window.orderBy(*arrival)).cast("long")
    ordered = splits.select(*[F.col(a).alias(f"_{a}") for a in arrival], order.alias("_split"), number.alias("load"))
    same = reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(f"_{a}")) for a in arrival])
    placed = rows.join(ordered, same)
    return placed.withColumn("position", F.col("_split") * (1 << 33) + line).select(
        *[c for c in rows.columns if c not in (*arrival, LINE)], "load", "position"
    )


def append_news(
    parsed: DataFrame,
    path: str,
    load: int,
    arrival: Sequence[str] = FILE_ARRIVAL,
    cfg: LookupConfig = LookupConfig(),
    members: MemberConfig = MemberConfig(),
    files_per_load: int | None = None,
) -> dict[str, int]:
    """Append accepted posts with unseen ids; their order is that of `arrival`, then line.

    `parsed` is a stored table with column `LINE`. Posts are dealt by the hash of their id into parts
    of at most about `ids_per_file` and `bytes_per_file`, and a filter of each part goes to the membership index before
    the part itself is written. The table is the memory of what was seen, so running a load again
    after a failure adds only what the failed attempt did not. One writer per table at a time.
    Returns how many ids the load had and how many of them were new.
    """
    spark = parsed.sparkSession
    create_news(spark, path)
    posts = first_versions(numbered_arrivals(accepted(parsed), arrival, load, files_per_load), ["position"])
    size = F.sum(F.octet_length("tweet"))
    posts, load_counts = stored_with_counts(posts, "load", {"ids": F.count("*"), "bytes": size})
    n_ids = load_counts["ids"]
    if n_ids == 0:
        return {"ids": 0, "appended": 0}
    fresh = unseen(posts, path, n_ids, cfg, members)
    buckets = buckets_for(n_ids, load_counts["bytes"], members)
    named = with_part(fresh, load, buckets)
    named = named.select(*schema.NEWS.fieldNames(), "bucket", "part")
    named, counts = stored_with_counts(named, "fresh", {"appended": F.count("*")})
    if counts["appended"] == 0:
        return {"ids": n_ids, **counts}
    add_filters(named, path, buckets, members)
    # a task for each part; rows in order of arrival
    dealt = named.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("part", "position")
    dealt.drop("bucket").write.mode("append").partitionBy("part").parquet(path)
    return {"ids": n_ids, **counts}
