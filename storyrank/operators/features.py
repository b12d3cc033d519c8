"""Term statistics, TF-IDF weights and term-count vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyrank.config import LookupConfig, TfIdfConfig
from storyrank.functions import text
from storyrank.operators.lookup import lookup
from storyrank.sources.scratch import stored


def tfidf_words(corpus: DataFrame, cfg: TfIdfConfig = TfIdfConfig()) -> DataFrame:
    """(id_str, words) after the second stop list."""
    return corpus.select(
        "id_str", text.without(text.split_words(F.col("clean")), cfg.stop_words).alias("words")
    )


def term_stats(words: DataFrame, n_docs: int, cfg: TfIdfConfig = TfIdfConfig()) -> DataFrame:
    """(term, df, idf) of the terms within the document frequency bounds.

    idf is ln((1 + n) / (1 + df)) + 1.
    """
    return (
        words.select(F.explode(F.array_distinct("words")).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
        .filter((F.col("df") >= cfg.min_df) & (F.col("df") <= math.floor(cfg.max_df * n_docs)))
        .withColumn("idf", F.log(F.lit(1.0 + n_docs) / (F.col("df") + 1.0)) + 1.0)
    )


def doc_terms(words: DataFrame) -> DataFrame:
    """(id_str, term, tf), counted inside each row: no shuffle."""
    counts = words.select("id_str", F.explode(text.term_counts(F.col("words"))).alias("c"))
    return counts.select("id_str", "c.term", "c.tf")


def tfidf_long(
    words: DataFrame,
    terms: DataFrame,
    cfg: LookupConfig = LookupConfig(),
    small: bool | None = None,
) -> DataFrame:
    """(id_str, term, weight): tf x idf, each document scaled to length one.

    With a table of proven size the posts are dealt by id while they are whole, so that their terms,
    which take more room, stay where they are made.
    """
    terms = terms.select("term", "idf")
    if small is None:
        terms = stored(terms, "lookup")
        small = terms.count() <= cfg.max_broadcast_rows
    if small:
        words = words.select("id_str", "words").repartition("id_str")
    raw = lookup(doc_terms(words), terms, ["term"], cfg, small=small)
    raw = raw.select("id_str", "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id_str")))
    return raw.select("id_str", "term", (F.col("raw") / norm).alias("weight"))


def tfidf_rows(words: DataFrame, vocabulary: pa.Table) -> DataFrame:
    """Replace `words` by the sparse unit TF-IDF row (`idx`, `val`) over a bounded vocabulary.

    `vocabulary` (term, idf) travels to the executors once and each Arrow batch is counted and
    weighed in place: no shuffle. Documents without any vocabulary term get an empty row.
    """
    keep = [c for c in words.columns if c != "words"]
    return count_rows(words, vocabulary, weighed=True).select(*keep, "idx", "val")


def count_rows(words: DataFrame, vocabulary: pa.Table, weighed: bool = False) -> DataFrame:
    """Replace `words` by its counts over a bounded vocabulary (`idx`, `val` whole numbers, `norm`).

    A TF-IDF cell is count x idf / `norm`, and is made where it is used: counts take a fraction of the room
    of weights. With `weighed`, `val` holds the weights themselves.
    """
    shipped = words.sparkSession.sparkContext.broadcast(
        (vocabulary["term"].combine_chunks(), vocabulary["idf"].to_numpy())
    )

    kind = "double" if weighed else "int"

    @F.arrow_udf(f"struct<idx:array<int>,val:array<{kind}>,norm:double>")
    def weigh(docs: pa.Array) -> pa.Array:
        terms, idf = shipped.value
        flat = docs.flatten()
        at = pc.index_in(flat, value_set=terms.cast(flat.type))
        sizes = pc.fill_null(pc.list_value_length(docs), 0).to_numpy()
        doc = np.repeat(np.arange(len(docs), dtype=np.int64), sizes)
        cells = doc[at.is_valid().to_numpy(zero_copy_only=False)] * len(idf) + at.drop_null().to_numpy()
        cells, tf = np.unique(cells, return_counts=True)
        doc, term = np.divmod(cells, len(idf))
        raw = tf * idf[term]
        norm = np.sqrt(np.bincount(doc, raw * raw, minlength=len(docs)))
        offsets = pa.array(np.searchsorted(doc, np.arange(len(docs) + 1)).astype(np.int32))
        idx = pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32)))
        val = pa.ListArray.from_arrays(offsets, pa.array(raw / norm[doc] if weighed else tf.astype(np.int32)))
        return pa.StructArray.from_arrays([idx, val, pa.array(norm)], ["idx", "val", "norm"])

    keep = [c for c in words.columns if c != "words"]
    return words.select(*keep, weigh("words").alias("_row")).select(*keep, "_row.idx", "_row.val", "_row.norm")


def frequent_terms(words: DataFrame, min_df: int, max_features: int) -> DataFrame:
    """(term, total, df): the most frequent terms found in at least `min_df` documents."""
    return (
        doc_terms(words)
        .groupBy("term")
        .agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
        .filter(F.col("df") >= min_df)
        .orderBy(F.col("total").desc(), "term")
        .limit(max_features)
    )


def term_count_long(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(id_str, term, tf) over a table of frequent terms; documents without any drop out."""
    return lookup(doc_terms(words), terms.select("term"), ["term"], small=True)
