"""Word and document vectors from co-occurrence counts.

Words that stand within a window of each other are counted, the counts become positive pointwise
mutual information, and the matrix of these is factored by the same blocked SVD as the documents
(Levy and Goldberg, 2014: shifted by ln k it stands for k negative samples). No text or vocabulary
meets on the driver, and of the matrix only a basis that fits one block.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyrank.config import LookupConfig, LsaConfig, WordVectorConfig
from storyrank.operators import lsa, pairs
from storyrank.operators.corpus import word_counts
from storyrank.operators.lookup import lookup
from storyrank.operators.lsa import _list_to_rows, _rows_to_list, _unit_rows
from storyrank.operators.nearest import nearest
from storyrank.operators.pairs import mapped, unpack, weighed_sums
from storyrank.operators.prefix import running_totals
from storyrank.sources import files
from storyrank.sources.scratch import discard, scratch_path, stored

# words whose pairs are made at a time, and pairs that are counted at a time
PAIR_WORDS = pairs.PAIR_WORDS
HELD_PAIRS = pairs.HELD_PAIRS


def window_pairs(sentences: DataFrame, window: int) -> DataFrame:
    """(a, b, n): how often `a` stands before or after `b`, at most `window` words away.

    Pairs of whole texts in array column `words`; equal ones of a task meet before the shuffle.
    """
    zipped = []
    for gap in range(1, window + 1):
        size = F.greatest(F.size("words") - gap, F.lit(0))
        first, second = F.slice("words", F.lit(1), size), F.slice("words", F.lit(1 + gap), size)
        zipped.append(F.arrays_zip(first.alias("a"), second.alias("b")))
    pairs = sentences.select(F.explode(F.concat(*zipped)).alias("p")).groupBy("p.a", "p.b")
    counted = stored(pairs.agg(F.count("*").alias("n")), "window-pairs")
    turned = counted.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")
    return counted.unionByName(turned).groupBy("a", "b").agg(F.sum("n").alias("n"))


def _kept_share(count: Column, total: float, sample: float) -> Column:
    """Expected share of a word that subsampling at rate `sample` keeps."""
    ratio = F.lit(sample) * total / count
    return F.least(F.sqrt(ratio) + ratio, F.lit(1.0))


def _numbered_words(sentences: DataFrame, min_count: int) -> DataFrame:
    """Stored (term, number, count) of the words counted often enough, the most frequent first."""
    known = word_counts(sentences, min_count)
    ordered = known.select((-F.col("count")).alias("rank"), F.col("word").alias("term"), F.lit(1).cast("long").alias("one"))
    numbered = running_totals(ordered, ["rank", "term"], ["one"])
    return stored(
        numbered.select("term", F.col("one_before").alias("number"), (-F.col("rank")).alias("count")), "numbered-words"
    )


def _numbered_texts(sentences: DataFrame, numbered: DataFrame, cfg: LookupConfig) -> DataFrame:
    """(words): texts as arrays of word numbers, null for words without one, for tables too large to travel."""
    texts = stored(sentences.select("words", F.monotonically_increasing_id().alias("_row")), "unnumbered")
    long = texts.select("_row", F.posexplode("words").alias("_pos", "term"))
    table = numbered.select("term", F.col("number").cast("int").alias("number"))
    found = lookup(long, table, ["term"], cfg, "left", small=False)
    placed = F.sort_array(F.collect_list(F.struct("_pos", "number")))
    return found.groupBy("_row").agg(placed.alias("p")).select(F.transform("p", lambda s: s["number"]).alias("words"))


def _packed_pairs(
    sentences: DataFrame, numbered: DataFrame, n_words: int, window: int, cfg: LookupConfig, total: int
) -> DataFrame:
    """Packed pairs of word numbers: how often two words stand at most `window` words apart.

    Words that are not numbered keep their place in the text and make no pair.
    """
    if n_words <= cfg.max_arrow_rows:
        known, texts = _terms(numbered), sentences
    else:
        known, texts = None, _numbered_texts(sentences, numbered, cfg)
    return pairs.count_pairs(texts, known, n_words, window, total, span=PAIR_WORDS, held_pairs=HELD_PAIRS)


def _terms(numbered: DataFrame) -> pa.Array:
    return numbered.orderBy("number").select("term").toArrow()["term"].combine_chunks()


def _numbered_pairs(
    sentences: DataFrame, numbered: DataFrame, n_words: int, window: int, cfg: LookupConfig
) -> DataFrame:
    """(a, b, n) by word numbers, a <= b: how often two words stand at most `window` words apart."""
    total = int(numbered.agg(F.sum("count")).first()[0] or 1)
    return pairs.pair_rows(_packed_pairs(sentences, numbered, n_words, window, cfg, total), n_words)


@dataclass(frozen=True)
class _Information:
    """What makes the information of a pair out of its count: columns by word number, on every task."""

    columns: Broadcast
    whole: float
    negatives: float

    def lift(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        share, sums = self.columns.value
        # a word beside itself counts from both places
        weight = n * np.where(a == b, 2, 1) * share[a] * share[b]
        return np.log(weight * self.whole / (sums[a] * sums[b])) - np.log(self.negatives)

    def positive(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Pairs whose information is above zero in six digits."""
        return self.lift(a, b, n) >= 5e-7


def _packed_information(
    sentences: DataFrame, numbered: DataFrame, n_words: int, cfg: WordVectorConfig, lookup_cfg: LookupConfig
) -> tuple[DataFrame, _Information, np.ndarray]:
    """(stored packed pairs, what makes their information, pairs of each word) for words that travel as
    columns. Of a pair only its count is stored, once."""
    context = sentences.sparkSession.sparkContext
    counts = numbered.orderBy("number").select(F.col("count").cast("double")).toArrow()["count"].to_numpy()
    total = float(counts.sum()) or 1.0
    ratio = cfg.sample * total / counts
    share = np.minimum(np.sqrt(ratio) + ratio, 1.0)
    packed = stored(_packed_pairs(sentences, numbered, max(n_words, 1), cfg.window, lookup_cfg, int(total)), "window-pairs")
    shipped = context.broadcast(share)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, found = np.zeros(n_words), np.zeros(n_words, np.int64)
        for batch in batches:
            for _, keys, n in unpack(batch):
                a, b = np.divmod(keys, n_words)
                w = n * np.where(a == b, 2, 1) * shipped.value[a] * shipped.value[b]
                apart = a != b
                for end, own in ((a, w), (b[apart], w[apart])):
                    weights += np.bincount(end, own, n_words)
                    found += np.bincount(end, minlength=n_words)
        for begin in range(0, n_words, pairs.SENT_ROWS):
            at = begin + np.flatnonzero(found[begin : begin + pairs.SENT_ROWS])
            yield pa.RecordBatch.from_pydict({
                "number": pa.array(at.astype(np.int32)), "w": pa.array(weights[at]), "pairs": pa.array(found[at])
            })

    parts = packed.coalesce(max(context.defaultParallelism, 1)).mapInArrow(ends, "number int, w double, pairs long")
    table = parts.groupBy("number").agg(F.sum("w").alias("w"), F.sum("pairs").alias("pairs")).toArrow()
    sums, cells = np.zeros(n_words), np.zeros(n_words, np.int64)
    at = table["number"].to_numpy()
    sums[at], cells[at] = table["w"].to_numpy(), table["pairs"].to_numpy()
    made = _Information(context.broadcast((share, sums)), float(sums.sum()) or 1.0, float(cfg.negatives))
    return packed, made, cells


def _numbered_information(
    sentences: DataFrame, numbered: DataFrame, n_words: int, cfg: WordVectorConfig, lookup_cfg: LookupConfig
) -> DataFrame:
    """(a, b, value) by word numbers, for any number of words. Pairs are kept once until the end."""
    total = float(numbered.agg(F.sum("count")).first()[0] or 1)
    small = n_words <= lookup_cfg.max_broadcast_rows
    shares = numbered.select(F.col("number").cast("int").alias("number"), _kept_share(F.col("count"), total, cfg.sample).alias("share"))
    found = stored(_numbered_pairs(sentences, numbered, max(n_words, 1), cfg.window, lookup_cfg), "window-pairs")
    for side in ("a", "b"):
        own = shares.select(F.col("number").alias(side), F.col("share").alias(f"share_{side}"))
        found = lookup(found, own, [side], lookup_cfg, small=small)
    # a word beside itself counts from both places
    twice = F.when(F.col("a") == F.col("b"), 2).otherwise(1)
    found = stored(
        found.select("a", "b", (F.col("n") * twice * F.col("share_a") * F.col("share_b")).alias("w")), "pair-weights"
    )
    ends = found.select("a", "w").unionByName(found.filter("a <> b").select(F.col("b").alias("a"), "w"))
    sums = stored(ends.groupBy("a").agg(F.sum("w").alias("sum_a")), "pair-sums")
    whole = float(sums.agg(F.sum("sum_a")).first()[0] or 1)
    found = lookup(found, sums, ["a"], lookup_cfg, small=small)
    found = lookup(found, sums.select(F.col("a").alias("b"), F.col("sum_a").alias("sum_b")), ["b"], lookup_cfg, small=small)
    lift = F.log(F.col("w") * whole / (F.col("sum_a") * F.col("sum_b"))) - F.log(F.lit(float(cfg.negatives)))
    positive = found.select("a", "b", lift.alias("value")).filter(F.round("value", 6) > 0)
    there, back = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    both = F.when(F.col("a") == F.col("b"), F.array(there)).otherwise(F.array(there, back))
    return positive.select(F.explode(both).alias("p"), "value").select("p.a", "p.b", "value")


def pointwise_information(
    sentences: DataFrame,
    cfg: WordVectorConfig = WordVectorConfig(),
    lookup_cfg: LookupConfig = LookupConfig(),
) -> tuple[DataFrame, DataFrame]:
    """((a, b, value), words): positive information of word pairs, and the words counted often
    enough. Frequent words count by the share that subsampling is expected to keep of them."""
    numbered = _numbered_words(sentences, cfg.min_count)
    n_words = numbered.count()
    words = numbered.select(F.col("term").alias("word"), "count")
    if n_words <= lookup_cfg.max_arrow_rows:
        packed, made, _ = _packed_information(sentences, numbered, n_words, cfg, lookup_cfg)
        return _named_information(packed, made, _terms(numbered), n_words), words
    values = _numbered_information(sentences, numbered, n_words, cfg, lookup_cfg)
    for side in ("a", "b"):
        names = numbered.select(F.col("number").cast("int").alias(side), F.col("term").alias(f"word_{side}"))
        values = lookup(values, names, [side], lookup_cfg, small=False)
    return values.select(F.col("word_a").alias("a"), F.col("word_b").alias("b"), "value"), words


def _named_information(packed: DataFrame, made: _Information, terms: pa.Array, n_words: int) -> DataFrame:
    """(a, b, value) of both directions of the positive pairs, by words."""
    shipped = packed.sparkSession.sparkContext.broadcast(terms)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, keys, n in unpack(batch):
                for begin in range(0, len(keys), pairs.SENT_ROWS):
                    a, b = np.divmod(keys[begin : begin + pairs.SENT_ROWS], n_words)
                    lift = made.lift(a, b, n[begin : begin + pairs.SENT_ROWS])
                    kept = lift >= 5e-7
                    a, b, lift = a[kept], b[kept], lift[kept]
                    for apart, first, second in ((None, a, b), (a != b, b, a)):
                        own = slice(None) if apart is None else apart
                        yield pa.RecordBatch.from_arrays(
                            [shipped.value.take(pa.array(x[own])) for x in (first, second)] + [pa.array(lift[own])],
                            ["a", "b", "value"],
                        )

    return packed.mapInArrow(named, "a string, b string, value double")


def fit_word_vectors(
    sentences: DataFrame,
    cfg: WordVectorConfig = WordVectorConfig(),
    lookup_cfg: LookupConfig = LookupConfig(),
) -> DataFrame:
    """(word, vector array) of the words of column `words`; stored."""
    spark = sentences.sparkSession
    numbered = _numbered_words(sentences, cfg.min_count)
    n_words = numbered.count()
    if n_words == 0:
        return spark.createDataFrame([], "word string, vector array<double>")
    shape = LsaConfig(components=cfg.size, rounds=cfg.rounds, seed=cfg.seed)
    folder = files.mounted(spark, scratch_path(spark, "word-factors"))
    if folder is not None and n_words <= lookup_cfg.max_arrow_rows:
        packed, made, cells = _packed_information(sentences, numbered, n_words, cfg, lookup_cfg)
        matrix = stored(pairs.square(packed, n_words, cells, made.positive), "word-matrix")
        discard(packed)
        rows, rotation = lsa.factor_square(matrix, numbered, n_words, made.lift, shape, folder)
        vectors = stored(_file_vectors(spark, rows, _terms(numbered), rotation), "word-vectors")
        discard(matrix, numbered)
        os.remove(rows)
        return vectors
    values = _numbered_information(sentences, numbered, n_words, cfg, lookup_cfg)
    cells = values.select(F.col("a").cast("long").alias("_doc"), F.col("b").alias("idx"), F.col("value").alias("val"))
    cells = stored(cells, "word-matrix")
    words = numbered.select(F.col("number").alias("_doc"), F.col("term").alias("word"))
    found = lsa.factor_cells(words, cells, numbered.select("term", "number"), n_words, shape)
    return stored(found.rows.select("word", F.col("lsa").alias("vector")), "word-vectors")


def _file_vectors(spark: SparkSession, path: str, terms: pa.Array, rotation: np.ndarray) -> DataFrame:
    """(word, vector): unit products of the rows of a mapped file with `rotation`."""
    shipped = spark.sparkContext.broadcast(terms)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = mapped(path, len(rotation))
        for batch in batches:
            for first in batch.column(0).to_pylist():
                words = shipped.value.slice(first, pairs.FACTOR_ROWS)
                own = _rows_to_list(_unit_rows(rows[first : first + len(words)] @ rotation))
                yield pa.RecordBatch.from_arrays([words, own], ["word", "vector"])

    return pairs.factor_ranges(spark, len(terms)).mapInArrow(vectors, "word string, vector array<double>")


def similar_words(vectors: DataFrame, examples: Sequence[str], n: int = 10) -> DataFrame:
    """(example, rank, word, similarity): nearest words by cosine, the example itself included.

    `examples` is a list to inspect; a word the model does not know gives no rows. For the
    neighbours of a whole table see `nearest`.
    """
    wanted = vectors.filter(F.col("word").isin(list(examples)))
    return nearest(vectors, wanted, n)


def document_vectors(
    vectors: DataFrame, docs: DataFrame, lookup_cfg: LookupConfig = LookupConfig()
) -> DataFrame:
    """(id_str, vector): mean of the word vectors over all words of a document; unknown words and
    documents without known words count as zero."""
    spark = docs.sparkSession
    folder = files.mounted(spark, scratch_path(spark, "vector-rows"))
    vectors = stored(vectors.select("word", "vector"), "vectors")
    head = vectors.select(F.size("vector")).first()
    if folder is not None and head and head[0] > 0 and vectors.count() <= lookup_cfg.max_arrow_rows:
        return _mean_in_place(vectors, docs, head[0], folder)
    keyed = stored(docs.select("id_str", "words", F.monotonically_increasing_id().alias("_doc")), "vector-docs")
    width = F.lit(vectors.select(F.size("vector")).first()[0] if vectors.head(1) else 0)
    long = keyed.select("_doc", F.explode("words").alias("word"))
    summed = (
        lookup(long, vectors, ["word"], lookup_cfg)
        .groupBy("_doc")
        .agg(vector_to_array(Summarizer.sum(array_to_vector("vector"))).alias("total"))
    )
    mean = F.transform("total", lambda x: x / F.size("words"))
    blank = F.array_repeat(F.lit(0.0), width)
    return keyed.join(summed, "_doc", "left").select("id_str", F.coalesce(mean, blank).alias("vector"))


def _mean_in_place(vectors: DataFrame, docs: DataFrame, width: int, folder: str) -> DataFrame:
    """Means with the vectors in a mapped file and the words on every task: neither texts nor vectors are dealt."""
    context = docs.sparkSession.sparkContext
    known = vectors.filter(F.col("word").isNotNull())
    words = known.select("word").orderBy("word").toArrow()["word"].combine_chunks()
    distinct = words.unique()
    if len(distinct) < len(words):
        # vectors of a repeated word add up
        total = vector_to_array(Summarizer.sum(array_to_vector("vector")))
        known = known.groupBy("word").agg(total.alias("vector"))
    path = pairs.reserve(f"{folder}/rows", max(len(distinct), 1), width)
    shipped = context.broadcast(distinct)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            at = pc.index_in(batch.column(0), value_set=shipped.value.cast(batch.column(0).type)).to_numpy()
            rows = _list_to_rows(batch.column(1)) if len(at) else []
            with open(path, "r+b") as file:
                for place, row in zip(at.tolist(), rows):
                    file.seek(place * width * 8)
                    file.write(row.tobytes())
            n += len(at)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    known.select("word", F.col("vector").cast("array<double>")).mapInArrow(save, "n long").agg(F.sum("n")).collect()

    @F.arrow_udf("array<double>")
    def mean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rows = mapped(path, width)
        for texts in batches:
            flat = texts.flatten()
            at = pc.index_in(flat, value_set=shipped.value.cast(flat.type), skip_nulls=True)
            sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(texts)), sizes)[at.is_valid().to_numpy(zero_copy_only=False)]
            total = weighed_sums(text, at.drop_null().to_numpy(), None, rows, np.zeros((len(texts), width)))
            yield _rows_to_list(total / np.maximum(sizes, 1)[:, None])

    return docs.select("id_str", mean("words").alias("vector"))
