"""Parts that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyrank.sources.scratch import stored

BATCH_ROWS = 2_000
BATCH_BYTES = "8m"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: str = BATCH_BYTES) -> None:
    """Keep Arrow batches of whole texts small, for long texts and small executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_of(df: DataFrame) -> Column:
    """All columns as one struct, so that names an operator adds cannot clash with them."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a long, b long); component: smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round hangs the
    neighbours of a node on its smallest neighbour, and the graph becomes a set of stars after a
    number of rounds that grows with the logarithm of its size. Rounds are written tables, the
    driver sees a count and a checksum.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    links = edges.filter(F.col("a") != F.col("b")).select(high.alias("u"), low.alias("v"))
    current = stored(links.distinct(), "links")
    mark = _checksum(current)
    while mark[0]:
        current = stored(_small_star(_large_star(current)), "links")
        new = _checksum(current)
        if new == mark:
            break
        mark = new
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(roots)


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = both.filter(F.col("v") > F.col("u"))
    return larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of these."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter(F.col("v") != F.col("m"))
    own = least.select("u", F.col("m").alias("v"))
    return own.unionByName(moved.select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def _checksum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
