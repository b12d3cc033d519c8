"""Schemas of the engine's inputs and tables."""

from __future__ import annotations

from pyspark.sql import types as T

STATUS = T.StructType(
    [
        T.StructField("id_str", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("retweet_count", T.StringType()),
    ]
)
STATUS_FIELDS = tuple(STATUS.fieldNames())
STATUS_MARKS = ("user", "text")

# `load` and `position` record arrival order: the ingest batch, then the place within it.
NEWS = T.StructType(
    [
        T.StructField("id_str", T.StringType()),
        T.StructField("tweet", T.StringType()),
        T.StructField("ctime", T.StringType()),
        T.StructField("rt_cnt", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("load", T.LongType()),
        T.StructField("position", T.LongType()),
    ]
)

CLEANED = T.StructType(
    [T.StructField("id_str", T.StringType()), T.StructField("clean", T.StringType())]
)
