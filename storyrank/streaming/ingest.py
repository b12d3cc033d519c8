"""Live ingest: a stream of statuses into the news table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storyrank.config import LookupConfig
from storyrank.operators.metrics import stored_with_counts
from storyrank.sources import files, news
from storyrank.sources.members import MemberConfig


def landed_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of status lines from a folder in which files land."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return news.with_arrival(reader.text(path))


def ingest_batch(
    lines: DataFrame,
    table: str,
    rejects: str | None = None,
    load: int = -1,
    arrival: Sequence[str] = news.FILE_ARRIVAL,
    cfg: LookupConfig = LookupConfig(),
    members: MemberConfig = MemberConfig(),
    files_per_load: int | None = None,
) -> dict[str, int]:
    """Load one batch of status lines, for example a backfill, before any stream batch.

    Every line is read and parsed once, into a scratch table that all steps start from. Returns counts
    of lines, outcomes by reason, ids and appended posts, taken on the passes that write. With
    `files_per_load` the batch holds several loads, each of so many files, numbered from `load`.
    """
    numbered = lines.withColumn(news.LINE, F.monotonically_increasing_id())
    parsed = news.parse_status(numbered)
    # the line of a good post is not needed again
    parsed = parsed.withColumn("value", F.when(F.col("reject").isNotNull(), F.col("value")))
    parsed, counts = stored_with_counts(parsed, "parsed", news.outcome_counts())
    counts |= news.append_news(parsed, table, load, arrival, cfg, members, files_per_load)
    if rejects is not None:
        # one folder per load: a load that runs again replaces its own rejects
        news.rejected(parsed).write.mode("overwrite").json(f"{rejects}/load={load}")
    return counts


def ingest_stream(
    lines: DataFrame,
    table: str,
    checkpoint: str,
    rejects: str | None = None,
    arrival: Sequence[str] = news.FILE_ARRIVAL,
    available_now: bool = False,
    interval: str = "10 seconds",
    cfg: LookupConfig = LookupConfig(),
    members: MemberConfig = MemberConfig(),
) -> StreamingQuery:
    """Write a stream of status lines to the news table, each id once, first version wins.

    A micro-batch that runs again after a failure finds its earlier rows in the table and adds
    only the missing ones. Bad lines go to `rejects` and never stop the stream. To run backfill
    and live together, union their streams into one query: a table has one writer.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, table, rejects, batch_id, arrival, cfg, members)

    writer = lines.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


# loads of a backfill come before those of the live stream that follows it
BACKFILL_LOADS = -(1 << 40)
# numbers of loads that each micro-batch of a backfill has for itself
BATCH_LOADS = 1 << 20


def backfill_pages(
    spark: SparkSession,
    pages: str,
    table: str,
    checkpoint: str,
    pages_per_load: int = 1,
    rejects: str | None = None,
    members: MemberConfig = MemberConfig(),
    most_batches: int = 32,
) -> StreamingQuery:
    """Load landed pages, one file of statuses each, oldest first, and end with the last one.

    Every `pages_per_load` pages are a load, whose number the table keeps. A micro-batch is one load;
    where the folder holds more than `most_batches` of them, it takes several side by side, so that
    the passes over the table do not grow in number with the pages. The table is the same either way:
    of an id that several loads bring, the first page has it.

    The checkpoint records every page that is done: a run that was stopped goes on with the micro-batch
    after, and one that starts when nothing has landed since does nothing. The live stream of
    `ingest_stream` on the same table follows when this has ended; ids of both meet in the table.
    `rejects` gets a folder for each micro-batch.
    """
    loads = -(-files.count(spark, pages) // pages_per_load)
    together = min(max(-(-loads // most_batches), 1), BATCH_LOADS)

    def load(batch: DataFrame, batch_id: int) -> None:
        first = BACKFILL_LOADS + batch_id * BATCH_LOADS
        ingest_batch(batch, table, rejects, first, members=members, files_per_load=pages_per_load)

    lines = landed_stream(spark, pages, pages_per_load * together)
    writer = lines.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"


def bounded_stream(
    lines: DataFrame,
    table: str,
    checkpoint: str,
    bound: str = "1 day",
    available_now: bool = False,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Write accepted posts of a stream to a table of files, each id once within `bound`.

    For streams that accept a bound: an id that comes back within `bound` of its first arrival is
    dropped, by a state that forgets ids older than that; one that comes back later is a new post,
    and lines that arrive later than the bound allows are dropped. No table is read. The time is that
    of the landed file. Of repeats within one micro-batch one is kept, which one is open. The state
    lies in RocksDB, on the disks of the executors and in the checkpoint, not in their memory.
    """
    spark = lines.sparkSession
    posts = news.accepted(news.parse_status(lines)).withWatermark("landed_at", bound)
    unique = posts.dropDuplicatesWithinWatermark(["id_str"])
    writer = unique.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    before = spark.conf.get(STORE_SETTING)
    # a query takes the settings of the session as they are when it starts
    spark.conf.set(STORE_SETTING, ROCKS)
    try:
        return writer.start(table)
    finally:
        spark.conf.set(STORE_SETTING, before)
