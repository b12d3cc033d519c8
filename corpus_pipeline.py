"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes all rows its predecessor kept and calls one operator. `run` writes what a stage
returns and reads it again for the next one, so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyrank.llm import config_packing, grace_dedup, pfair_mix, simhash_gray, toxic_segments
from storyrank.llm.common import table
from storyrank.llm.tokens import TokenizerSpec
from storyrank.sources.scratch import stored


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic passages do not add up to a rejection."""
    scored = toxic_segments.score_texts(docs, table(spark, sf_dir, "labels"))
    return scored.filter(F.col("predicted") == 0).select("row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, that with the largest id."""
    return grace_dedup.drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints hang together, that with the smallest id."""
    return simhash_gray.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, interleaved by the weights of their sources."""
    return pfair_mix.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences, which keep the mixed order."""
    tokenizer = TokenizerSpec.read(public_tokenizers.path("byte_bpe_50k.json"))
    return config_packing.pack_in_order(in_row_order(docs), tokenizer, 2, ["file", "part_of_file", "line"])


def in_row_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and what orders the rows: number of the written file, then the row in it.

    Readers deal files and their splits by size, so the tasks of a scan are not in this order. Rows
    that do not come from files stand in the order of their partitions.
    """
    name = F.col("_metadata.file_name")
    number = lambda pattern: F.regexp_extract(name, pattern, 1).try_cast("long")
    try:
        return docs.select(
            "doc_id", "text", number(r"part-(\d+)").alias("file"),
            number(r"-c(\d+)\.").alias("part_of_file"), F.col("_metadata.row_index").alias("line"),
        )
    except AnalysisException:
        none = F.lit(0).cast("long")
        line = F.monotonically_increasing_id()
        return docs.select("doc_id", "text", none.alias("file"), none.alias("part_of_file"), line.alias("line"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash", without_near_copies),
    ("mix", mixed),
    ("pack", packed),
]

# scores, fingerprints and token ids are not within reach of SQL; tests use a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
