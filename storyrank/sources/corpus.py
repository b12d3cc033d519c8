"""Cleaned corpus files: `id,words` lines or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyrank.schema import CLEANED


def write_cleaned(cleaned: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write (id_str, clean) as `parquet`, or as `text` lines `id,words` without quoting."""
    if fmt == "text":
        cleaned.select(F.concat_ws(",", "id_str", "clean")).write.text(path)
    else:
        cleaned.select("id_str", "clean").write.format(fmt).save(path)


def read_cleaned(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a cleaned corpus; a text line that is not exactly two parts is an error."""
    if fmt != "text":
        return spark.read.schema(CLEANED).format(fmt).load(path)
    parts = F.split(F.trim("value"), ",", -1)
    bad = F.raise_error(F.concat(F.lit("not an `id,words` line: "), "value"))
    lines = spark.read.text(path).select(F.when(F.size(parts) == 2, parts).otherwise(bad).alias("p"))
    return lines.select(F.get("p", F.lit(0)).alias("id_str"), F.get("p", F.lit(1)).alias("clean"))
