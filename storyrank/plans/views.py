"""Views over the driver tables that the registered queries start from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CTIME_FORMAT = "EEE MMM dd HH:mm:ss '+0000' yyyy"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts: (id_str, tweet, seq, source, lang)."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return documents.select(
        F.col("doc_id").cast("string").alias("id_str"),
        F.col("text").alias("tweet"),
        F.col("doc_id").alias("seq"),
        "source",
        "lang",
    )


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with the marks that cleaning strips: repost marker, mention, tag and link."""
    marked = F.concat(
        F.lit("RT @user"), "id_str", F.lit(": "), "tweet",
        F.lit(" #tag"), (F.col("seq") % 7).cast("string"), F.lit(" https://t.co/"), "id_str",
    )
    return posts(spark, sf_dir).withColumn("tweet", marked)


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with time and reposts from `events`: (.., ctime, rt_cnt, event_type)."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.date_format("ts", CTIME_FORMAT).alias("ctime"),
        F.floor("value").cast("int").alias("rt_cnt"),
        "event_type",
    )
    return posts(spark, sf_dir).join(events, "seq")


def status_lines(news_rows: DataFrame, extra_reposts: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """One JSON status per post in column `value`, with the flaws of a live feed; columns `keep` stay.

    Posts of event type `error` are cut off, those of type `signup` come without a user and
    those of type `view` with a null one.
    """
    status = F.struct(
        "id_str",
        F.col("tweet").alias("text"),
        F.col("ctime").alias("created_at"),
        (F.col("rt_cnt") + extra_reposts).alias("retweet_count"),
        F.struct(F.col("source").alias("name")).alias("user"),
    )
    whole = F.to_json(status)
    userless = F.to_json(status.dropFields("user"))
    nameless = F.concat(F.lit('{"user":null,'), F.substring(userless, F.lit(2), F.length(userless)))
    line = (
        F.when(F.col("event_type") == "error", F.substring(whole, F.lit(1), F.length(whole) - 5))
        .when(F.col("event_type") == "signup", userless)
        .when(F.col("event_type") == "view", nameless)
        .otherwise(whole)
    )
    return news_rows.select(*keep, line.alias("value"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as clustered posts: (vec_id, cluster, vector, seq)."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.col("label").alias("cluster"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.col("vec_id").alias("seq"),
    )


def vocabulary(words: DataFrame) -> DataFrame:
    return words.select(F.explode("words").alias("token")).distinct()


def suffix_lemmas(tokens: DataFrame) -> DataFrame:
    """Rule-made lexicon (token, pos, lemma) for a vocabulary."""
    noun = tokens.filter(F.col("token").endswith("s")).select(
        "token", F.lit("n").alias("pos"), F.regexp_replace("token", "s$", "").alias("lemma")
    )
    verb = tokens.filter(F.col("token").rlike("(ing|ed)$")).select(
        "token", F.lit("v").alias("pos"), F.regexp_replace("token", "(ing|ed)$", "").alias("lemma")
    )
    return noun.unionByName(verb)


def suffix_stems(tokens: DataFrame) -> DataFrame:
    """Rule-made lexicon (token, stem) for a vocabulary."""
    return tokens.filter(F.col("token").rlike("(ment|tion|ly)$")).select(
        "token", F.regexp_replace("token", "(ment|tion|ly)$", "").alias("stem")
    )


def suffix_tags(tokens: DataFrame) -> DataFrame:
    """Rule-made lexicon (token, tag) for a vocabulary; most words are left to the default."""
    tag = (
        F.when(F.col("token").endswith("ing"), "VBG")
        .when(F.col("token").endswith("ed"), "VBD")
        .when(F.col("token").endswith("ly"), "RB")
        .when(F.col("token").endswith("able"), "JJ")
    )
    return tokens.select("token", tag.alias("tag")).filter(F.col("tag").isNotNull())
