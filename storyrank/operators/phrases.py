"""Phrases: score adjacent word pairs and join the accepted ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyrank.config import LookupConfig, PhraseConfig
from storyrank.operators.corpus import word_counts
from storyrank.operators.lookup import lookup
from storyrank.operators.pairs import count_pairs, unpack
from storyrank.sources.scratch import discard, stored

# texts of a batch that are read at a time
READ_TEXTS = 64


def pair_counts(corpus: DataFrame) -> DataFrame:
    """(a, b, n): adjacent pairs of `clean`; the last word of a text pairs with NULL.

    One pass over the text serves pairs and single words: a word occurs as often as it opens a
    pair, NULL pairs included.
    """
    words = corpus.select(F.split("clean", " ").alias("words"))
    pairs = words.select(F.explode(_neighbours("words")).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def _neighbours(words: str) -> Column:
    """array<struct<a,b>>: each word with the next one, NULL after the last; empty for no words."""
    size = F.size(words)
    shifted = F.concat(F.slice(words, F.lit(2), size), F.array(F.lit(None).cast("string")))
    following = F.slice(shifted, F.lit(1), size)
    return F.arrays_zip(F.col(words).alias("a"), following.alias("b"))


def phrase_scores(
    corpus: DataFrame, cfg: PhraseConfig = PhraseConfig(), lookup_cfg: LookupConfig = LookupConfig()
) -> DataFrame:
    """(a, b, n, score) of the accepted pairs.

    score = (n(ab) - min_count) * N / (n(a) * n(b)) with N the number of distinct words and
    pairs; a pair needs n(ab) >= min_count and a score above the threshold. Words that travel as a column
    are counted as numbers; more of them are counted as words.
    """
    texts = corpus.select(F.split("clean", " ").alias("words"))
    words = stored(word_counts(texts), "words")
    # a word that occurs once makes a new pair wherever it stands, so it needs no number
    least = 2 if cfg.min_count >= 2 else 1
    known = words.filter(F.col("count") >= least)
    if known.count() <= lookup_cfg.max_arrow_rows:
        return _scores(*_packed_pairs(texts, words, known, cfg), cfg)
    discard(words)
    counted = stored(pair_counts(corpus), "pairs")
    words = stored(counted.groupBy("a").agg(F.sum("n").alias("n_word")), "words")
    n_vocabulary = words.count() + counted.filter(F.col("b").isNotNull()).count()
    # a word of a frequent pair is at least as frequent as the pair
    frequent = words.filter(F.col("n_word") >= cfg.min_count)
    small = frequent.count() <= lookup_cfg.max_broadcast_rows
    pairs = counted.filter(F.col("b").isNotNull() & (F.col("n") >= cfg.min_count))
    first = frequent.select("a", F.col("n_word").alias("n_a"))
    second = frequent.select(F.col("a").alias("b"), F.col("n_word").alias("n_b"))
    pairs = lookup(pairs, first, ["a"], lookup_cfg, small=small)
    return _scores(lookup(pairs, second, ["b"], lookup_cfg, small=small), n_vocabulary, cfg)


def _scores(pairs: DataFrame, n_vocabulary: int, cfg: PhraseConfig) -> DataFrame:
    """Accepted pairs of (a, b, n, n_a, n_b)."""
    lift = (F.col("n") - cfg.min_count) * F.lit(float(n_vocabulary)) / (F.col("n_a") * F.col("n_b"))
    return (
        pairs.withColumn("score", lift)
        .filter(F.col("score") > cfg.threshold)
        .select("a", "b", "n", "score")
    )


def _packed_pairs(texts: DataFrame, words: DataFrame, known: DataFrame, cfg: PhraseConfig) -> tuple[DataFrame, int]:
    """((a, b, n, n_a, n_b) of pairs counted often enough, how many words and pairs there are).

    Of the pairs with a word that has no number only their places are counted: each is a pair of its own.
    """
    table = known.orderBy(F.col("count").desc(), "word").toArrow()
    terms, n_words = table["word"].combine_chunks(), max(table.num_rows, 1)
    sizes = words.agg(F.count("*"), F.sum("count")).first()
    total, filled = sizes[1] or 0, texts.filter(F.size("words") > 0).count()
    packed = stored(count_pairs(texts, terms, n_words, 1, total, ordered=True), "pairs")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        different, places = 0, 0
        for batch in batches:
            for _, keys, n in unpack(batch):
                different, places = different + len(keys), places + int(n.sum())
        yield pa.RecordBatch.from_pydict({"different": pa.array([different]), "places": pa.array([places])})

    found = packed.mapInArrow(met, "different long, places long").agg(F.sum("different"), F.sum("places")).first()
    n_vocabulary = sizes[0] + (found[0] or 0) + (total - filled) - (found[1] or 0)
    shipped = texts.sparkSession.sparkContext.broadcast((terms, table["count"].combine_chunks()))
    least = cfg.min_count

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, keys, n in unpack(batch):
                often = n >= least
                ends = [pa.array(x) for x in np.divmod(keys[often], n_words)]
                columns = [values.take(x) for values in shipped.value for x in ends]
                yield pa.RecordBatch.from_arrays([*columns[:2], pa.array(n[often]), *columns[2:]], ["a", "b", "n", "n_a", "n_b"])

    return packed.mapInArrow(named, "a string, b string, n long, n_a long, n_b long"), n_vocabulary


def merge_phrases(
    docs: DataFrame,
    accepted: DataFrame,
    cfg: PhraseConfig = PhraseConfig(),
    lookup_cfg: LookupConfig = LookupConfig(),
) -> DataFrame:
    """(id_str, words): array column `words` with accepted pairs joined, left to right.

    A greedy reader takes a pair when it is accepted and goes on after it. A table of proven size
    travels to the executors and every document is read in place; a larger one is joined by
    shuffle. Documents without words keep their row.
    """
    pairs = accepted.select("a", "b").limit(lookup_cfg.max_broadcast_rows + 1).toArrow()
    if pairs.num_rows <= lookup_cfg.max_broadcast_rows:
        return _merge_in_place(docs, pairs, cfg)
    return _merge_by_join(docs, accepted, cfg, lookup_cfg)


def _merge_in_place(docs: DataFrame, pairs: pa.Table, cfg: PhraseConfig) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast((pairs["a"].to_pylist(), pairs["b"].to_pylist()))
    delimiter = cfg.delimiter

    @F.arrow_udf("array<string>")
    def merged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = set(zip(*shipped.value))  # once per task
        for words in batches:
            yield _read_texts(words, known, delimiter)

    return docs.select("id_str", merged("words").alias("words"))


def _read_texts(words: pa.Array, known: set[tuple[str, str]], delimiter: str) -> pa.Array:
    """Every text of a batch; a few at a time are lists of Python, never the whole batch."""
    parts = [pa.array([], pa.list_(pa.string()))]
    for begin in range(0, len(words), READ_TEXTS):
        read = [_read(w or [], known, delimiter) for w in words.slice(begin, READ_TEXTS).to_pylist()]
        parts.append(pa.array(read, pa.list_(pa.string())))
    return pa.concat_arrays(parts)


def _read(words: list[str], known: set[tuple[str, str]], delimiter: str) -> list[str]:
    out, at = [], 0
    while at < len(words):
        pair = tuple(words[at : at + 2])
        if pair in known:
            out.append(delimiter.join(pair))
            at += 1
        else:
            out.append(words[at])
        at += 1
    return out


def _merge_by_join(
    docs: DataFrame, accepted: DataFrame, cfg: PhraseConfig, lookup_cfg: LookupConfig
) -> DataFrame:
    """In a run of overlapping accepted pairs every second one is taken, starting with the first,
    which is what the greedy reader does. The windows span one document each."""
    docs = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "unmerged")
    positions = docs.select("_row", F.posexplode(_neighbours("words")).alias("pos", "p"))
    long = positions.select("_row", "pos", "p.a", "p.b")
    known = accepted.select("a", "b", F.lit(True).alias("hit"))
    # the last word of a text has no pair to look up, and no null key goes into the join
    inner = lookup(long.filter(F.col("b").isNotNull()), known, ["a", "b"], lookup_cfg, how="left", small=False)
    last = long.filter(F.col("b").isNull()).withColumn("hit", F.lit(None).cast("boolean"))
    marked = inner.unionByName(last)

    in_order = Window.partitionBy("_row").orderBy("pos")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.coalesce(F.last(F.when(F.col("hit").isNull(), F.col("pos")), True).over(so_far), F.lit(-1))
    taken = F.col("hit").isNotNull() & ((F.col("pos") - gap - 1) % 2 == 0)
    read = (
        marked.withColumn("taken", taken)
        .withColumn("used", F.coalesce(F.lag("taken").over(in_order), F.lit(False)))
        .filter(~F.col("used"))
    )
    word = F.when(F.col("taken"), F.concat_ws(cfg.delimiter, "a", "b")).otherwise(F.col("a"))
    gathered = read.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("pos", word.alias("w")))).alias("_placed")
    )
    words = F.transform(F.coalesce("_placed", F.array().cast("array<struct<pos:int,w:string>>")), lambda s: s["w"])
    return docs.select("_row", "id_str").join(gathered, "_row", "left").select("id_str", words.alias("words"))
