"""Topics: latent Dirichlet allocation over the most frequent terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyrank.config import LookupConfig, TopicConfig
from storyrank.functions import vectors
from storyrank.operators.features import doc_terms, frequent_terms
from storyrank.operators.lookup import lookup
from storyrank.operators.topk import top_per_group
from storyrank.sources.scratch import stored

# posts that a task fits side by side
DENSE_POSTS = 256
# double steps of a post that are extrapolated
EXTRAPOLATED = 200


@dataclass(frozen=True)
class Topics:
    """`weights`: topics x terms, what a topic holds of each term. `prior`: one number for each topic.
    `counts`: stored (id_str, idx, tf), positions in the vocabulary and their counts."""

    weights: np.ndarray
    prior: np.ndarray
    vocabulary: list[str]
    counts: DataFrame


def count_vectors(words: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(id_str, idx, tf): term counts over a bounded vocabulary; empty rows drop out."""
    counter = CountVectorizerModel.from_vocabulary(
        vocabulary, inputCol="words", outputCol="features"
    )
    sparse = F.unwrap_udt("features")
    counted = counter.transform(words).select("id_str", sparse["indices"].alias("idx"), sparse["values"].alias("tf"))
    return counted.filter(F.size("idx") > 0)


def fit_topics(words: DataFrame, cfg: TopicConfig = TopicConfig()) -> Topics:
    """Online variational Bayes (Hoffman, Blei and Bach, 2010) whose every iteration reads all posts.

    Tasks fit the posts of an Arrow batch side by side, as products of small matrices, and add up
    topics x terms numbers, which meet on the driver. Learning rate, prior updates and the
    precision of a post's shares are those of Spark's LDA.
    """
    # at most cfg.max_features terms reach the driver
    vocabulary = [r["term"] for r in frequent_terms(words, cfg.min_df, cfg.max_features).collect()]
    counts = stored(count_vectors(words, vocabulary), "term-counts")
    weights = np.random.default_rng(cfg.seed).gamma(100.0, 0.01, (cfg.k, len(vocabulary)))
    prior = np.full(cfg.k, 1.0 / cfg.k)
    for number in range(1, cfg.max_iter + 1):
        sums, logs, posts = _batch_sums(counts, weights, prior)
        if posts == 0:
            break
        rate = (1024.0 + number) ** -0.51
        weights = (1.0 - rate) * weights + rate * (sums + 1.0 / cfg.k)
        prior = _moved_prior(prior, logs / posts, posts, rate)
    return Topics(weights, prior, vocabulary, counts)


def _batch_sums(counts: DataFrame, weights: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(topics x terms sums, sums of log shares, posts) of one pass over all posts."""
    topics, terms = weights.shape
    likely = np.exp(_log_means(weights))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((topics, terms + 2))
        for batch in batches:
            for _, dense in _dense_runs(batch.column(0), batch.column(1), terms):
                logs = _log_means(_post_shares(dense, likely, prior))
                part = np.exp(logs)
                total[:, :terms] += part.T @ (dense / (part @ likely + 1e-100))
                total[:, terms] += logs.sum(axis=0)
                total[:, terms + 1] += len(dense)
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(range(topics), pa.int32()), "v": pa.array(list(total), pa.list_(pa.float64())),
        })

    parts = counts.select("idx", "tf").mapInArrow(partial, "i int, v array<double>")
    summed = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    rows = {r["i"]: r["v"] for r in summed.collect()}
    total = np.array([rows.get(i, [0.0] * (terms + 2)) for i in range(topics)])
    return total[:, :terms] * likely, total[:, terms], float(total[0, terms + 1])


def _post_shares(dense: np.ndarray, likely: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Dirichlet parameters (posts x topics) of counts (posts x terms); a post is done when a step
    changes its parameters by no more than 0.001 on average.

    Two steps are carried on by squared extrapolation (Varadhan and Roland, 2008), which needs fewer
    steps to the same point; a post that is not done after many goes on by plain steps.
    """

    def step(x: np.ndarray) -> np.ndarray:
        part = np.exp(_log_means(x))
        return prior + part * ((counts / (part @ likely + 1e-100)) @ likely.T)

    out = prior + dense.sum(axis=1, keepdims=True) / len(prior) * np.ones(len(prior))
    left, counts, turns = np.arange(len(dense)), dense, 0
    while len(left):
        first = out[left]
        second = step(first)
        third = step(second)
        turns += 1
        moving = np.abs(third - second).mean(axis=1) > 1e-3
        following = third
        if turns <= EXTRAPOLATED:
            a, b, c = np.log(first), np.log(second), np.log(third)
            speed, bend = b - a, c - 2 * b + a
            length = np.sqrt((speed**2).sum(axis=1) / np.maximum((bend**2).sum(axis=1), 1e-300))
            length = np.clip(length, 1.0, 32.0)[:, None]
            ahead = np.maximum(np.exp(a + 2 * length * speed + length**2 * bend), prior)
            following = np.where(moving[:, None], ahead, third)
        out[left] = following
        if not moving.all():
            left, counts = left[moving], counts[moving]
    return out


def _dense_runs(idx: pa.Array, tf: pa.Array, terms: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Sparse rows, some at a time, as a posts x terms matrix."""
    for begin in range(0, len(idx), DENSE_POSTS):
        own, values = idx.slice(begin, DENSE_POSTS), tf.slice(begin, DENSE_POSTS)
        dense = np.zeros((len(own), terms))
        row = np.repeat(np.arange(len(own)), pc.list_value_length(own).to_numpy(zero_copy_only=False))
        dense[row, own.flatten().to_numpy(zero_copy_only=False)] = values.flatten().to_numpy(zero_copy_only=False)
        yield slice(begin, begin + len(own)), dense


def _moved_prior(prior: np.ndarray, logs: np.ndarray, posts: float, rate: float) -> np.ndarray:
    """One Newton step (Huang, 2005) towards the prior that explains the mean log shares."""
    gradient = posts * (logs - _log_means(prior[None])[0])
    curve, whole = -posts * _trigamma(prior), posts * _trigamma(prior.sum())
    step = -(gradient - (gradient / curve).sum() / (1.0 / whole + (1.0 / curve).sum())) / curve
    moved = prior + rate * step
    return moved if (moved > 0).all() else prior


def _log_means(x: np.ndarray) -> np.ndarray:
    """Means of the logarithms under a Dirichlet distribution for each row of parameters."""
    return _digamma(x) - _digamma(x.sum(axis=1, keepdims=True))


def _digamma(x: np.ndarray) -> np.ndarray:
    """Series at x + 6, carried back by recurrence; for positive numbers."""
    y, head = x + 6.0, 1.0 / x
    for k in range(1, 6):
        head = head + 1.0 / (x + k)
    z = 1.0 / (y * y)
    tail = z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z * (1 / 132 - z * 691 / 32760)))))
    return np.log(y) - 0.5 / y - tail - head


def _trigamma(x: np.ndarray) -> np.ndarray:
    y, head = x + 6.0, 0.0
    for k in range(6):
        head = head + 1.0 / ((x + k) * (x + k))
    z = 1.0 / (y * y)
    tail = z * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z * (1 / 30 - z * 5 / 66))))
    return head + 1.0 / y + 0.5 * z + tail / y


def topic_words(topics: Topics, n: int = 10) -> DataFrame:
    """(topic, rank, term, weight): the heaviest words of each topic."""
    shares = topics.weights / topics.weights.sum(axis=1, keepdims=True)
    order = np.argsort(-shares, axis=1, kind="stable")[:, :n]
    rows = [
        (topic, rank, topics.vocabulary[at], float(shares[topic, at]))
        for topic, own in enumerate(order)
        for rank, at in enumerate(own, 1)
    ]
    return topics.counts.sparkSession.createDataFrame(rows, "topic int, rank int, term string, weight double")


def topic_mix(topics: Topics) -> DataFrame:
    """(id_str, mix, topic): topic shares of each post and the largest one."""
    likely, prior = np.exp(_log_means(topics.weights)), topics.prior

    @F.arrow_udf("array<double>")
    def mixed(idx: pa.Array, tf: pa.Array) -> pa.Array:
        out = np.zeros((len(idx), len(prior)))
        for at, dense in _dense_runs(idx, tf, likely.shape[1]):
            out[at] = _post_shares(dense, likely, prior)
        out /= out.sum(axis=1, keepdims=True)
        offsets = pa.array(np.arange(len(idx) + 1, dtype=np.int32) * len(prior))
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    shares = topics.counts.select("id_str", mixed("idx", "tf").alias("mix"))
    return shares.withColumn("topic", vectors.argmax(F.col("mix")))


def group_topics(words: DataFrame, group: str, terms: DataFrame, smoothing: float = 0.1) -> DataFrame:
    """(topic, term, weight) of given groups of posts: the smoothed share of each term among the
    words of the group that are in `terms` (term). Each group has every term."""
    counted = words.select(F.col(group).alias("topic"), "words")
    known = F.broadcast(terms.select("term"))
    pairs = counted.select("topic", F.explode("words").alias("term")).join(known, "term")
    sums = stored(pairs.groupBy("topic", "term").agg(F.count("*").alias("n")), "group-terms")
    whole = sums.groupBy("topic").agg(F.sum("n").alias("all"))
    size = terms.count()
    every = whole.select("topic", "all", F.explode(F.array(*[F.lit(r["term"]) for r in terms.collect()])).alias("term"))
    share = (F.coalesce("n", F.lit(0)) + smoothing) / (F.col("all") + smoothing * size)
    return every.join(sums, ["topic", "term"], "left").select("topic", "term", share.alias("weight"))


def heaviest_words(topic_terms: DataFrame, n: int = 10) -> DataFrame:
    """(topic, rank, term, weight) of a topic-term table; weights that agree in nine digits tie."""
    order = [F.round("weight", 9).desc(), F.col("term")]
    return top_per_group(topic_terms, "topic", order, n, spread_on="term").select("topic", "rank", "term", "weight")


def fold_in(
    words: DataFrame, topic_terms: DataFrame, steps: int = 20, cfg: LookupConfig = LookupConfig()
) -> DataFrame:
    """(id_str, mix, topic) of posts (id_str, words) under a given topic-term table (topic, term,
    weight), without fitting anything.

    `mix` holds the topic shares in order of the topics, after `steps` steps of expectation and
    maximisation from even shares; `topic` is the first of the largest, compared after rounding to
    nine digits. Posts without a word that some topic has are left out. A table of proven size
    travels to the posts, which are folded in place; the words of a larger one are looked up by a
    join, and a post then gathers one row of weights for each of its words.
    """
    names = [r["topic"] for r in topic_terms.select("topic").distinct().orderBy("topic").collect()]
    if not names:
        blank = F.lit(None).cast("array<double>").alias("mix")
        return words.select("id_str", blank, F.lit(None).cast(dict(topic_terms.dtypes)["topic"]).alias("topic")).limit(0)
    number = F.array_position(F.array(*[F.lit(t) for t in names]), F.col("topic")) - 1
    cells = F.map_from_entries(F.collect_list(F.struct(number.cast("int").alias("i"), "weight")))
    weights = F.transform(
        F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(0.0))
    )
    table = topic_terms.filter(F.col("weight") > 0).groupBy("term").agg(cells.alias("cells"))
    table = stored(table.select("term", weights.alias("weights")), "term-topics")
    # a term counts as much as a key and a number for each topic
    if table.count() * len(names) <= cfg.max_broadcast_rows:
        mixed = _fold_in_place(words, table.orderBy("term").toArrow(), len(names), steps)
    else:
        looked = lookup(doc_terms(words), table, ["term"], cfg, small=False)
        own = F.sort_array(F.collect_list(F.struct("term", "tf", "weights"))).alias("cells")
        mixed = _fold_gathered(looked.groupBy("id_str").agg(own), len(names), steps)
    best = vectors.argmax(F.transform("mix", lambda s: F.round(s, 9)))
    found = F.get(F.array(*[F.lit(t) for t in names]), best)
    return mixed.filter(F.col("mix").isNotNull()).withColumn("topic", found)


def _fold_in_place(words: DataFrame, table: pa.Table, topics: int, steps: int) -> DataFrame:
    shipped = words.sparkSession.sparkContext.broadcast(
        (table["term"].combine_chunks(), _rows(table["weights"].combine_chunks(), topics))
    )

    @F.arrow_udf("array<double>")
    def fold(docs: pa.Array) -> pa.Array:
        terms, weights = shipped.value
        flat = docs.flatten()
        at = pc.index_in(flat, value_set=terms.cast(flat.type))
        sizes = pc.fill_null(pc.list_value_length(docs), 0).to_numpy()
        known = at.is_valid().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(docs), dtype=np.int64), sizes)[known]
        cells, tf = np.unique(doc * len(terms) + at.drop_null().to_numpy(), return_counts=True)
        doc, term = np.divmod(cells, max(len(terms), 1))
        return _shares(doc, tf, weights[term], len(docs), topics, steps)

    return words.select("id_str", fold("words").alias("mix"))


def _fold_gathered(gathered: DataFrame, topics: int, steps: int) -> DataFrame:
    @F.arrow_udf("array<double>")
    def fold(cells: pa.Array) -> pa.Array:
        flat = cells.flatten()
        doc = np.repeat(np.arange(len(cells)), pc.list_value_length(cells).to_numpy())
        tf = flat.field("tf").to_numpy(zero_copy_only=False)
        return _shares(doc, tf, _rows(flat.field("weights"), topics), len(cells), topics, steps)

    return gathered.select("id_str", fold("cells").alias("mix"))


def _rows(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _shares(doc, tf, weights, n: int, topics: int, steps: int) -> pa.Array:
    """Topic shares of `n` posts whose words, in order of posts, have `tf` and rows of `weights`."""
    share = np.full((n, topics), 1.0 / topics)
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    filled = doc[starts]
    for _ in range(steps if len(doc) else 0):
        part = share[doc] * weights
        part *= (tf / part.sum(axis=1))[:, None]
        sums = np.add.reduceat(part, starts, axis=0)
        share[filled] = sums / sums.sum(axis=1, keepdims=True)
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * topics)
    made = pa.ListArray.from_arrays(offsets, pa.array(share.ravel()))
    place = np.full(n, -1)
    place[filled] = filled
    return made.take(pa.array(place, mask=place < 0))
