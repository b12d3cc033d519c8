"""Query registry: one function per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyrank.config import (
    CleanConfig,
    ClusterConfig,
    PhraseConfig,
    PipelineConfig,
    RankConfig,
    TopicConfig,
    WordVectorConfig,
)
from storyrank.functions import text, vectors
from storyrank.operators import cluster, corpus, embed, features, lsa, phrases, rank, topics
from storyrank.operators.clean import clean_posts
from storyrank.operators.lookup import lookup
from storyrank.plans import hot_news as plan
from storyrank.plans import views
from storyrank.sources import news as news_source
from storyrank.sources.reports import report_lines
from storyrank.sources.scratch import scratch_path, stored
from storyrank.streaming import ingest

WHOLE_JOB = PipelineConfig(clean=CleanConfig(lemmatise=True))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _lexicons(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored (lemmas, tags) of the words of the posts and of their lemmas."""
    tokens = stored(views.vocabulary(clean_posts(posts)), "vocabulary")
    lemmas = stored(views.suffix_lemmas(tokens), "lemmas")
    words = tokens.unionByName(lemmas.select(F.col("lemma").alias("token"))).distinct()
    return lemmas, stored(views.suffix_tags(words), "tags")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored corpus (clean, id_str, seq)."""
    return plan.build_corpus(views.posts(spark, sf_dir).select("id_str", "tweet", "seq"))


# ------------------------------------------------------------------------- cleaning


@query
def clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = views.decorated(spark, sf_dir).select("id_str", "tweet")
    return clean_posts(posts).select("id_str", "clean")


@query
def clean_corpus_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without stop word removal."""
    posts = views.decorated(spark, sf_dir).select("id_str", "tweet")
    return clean_posts(posts, CleanConfig(remove_stop=False)).select("id_str", "clean")


@query
def clean_corpus_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = views.decorated(spark, sf_dir).select("id_str", "tweet")
    tokens = stored(views.vocabulary(clean_posts(posts)), "vocabulary")
    cfg = CleanConfig(lemmatise=True)
    return clean_posts(posts, cfg, lemmas=views.suffix_lemmas(tokens)).select("id_str", "clean")


@query
def clean_corpus_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = views.decorated(spark, sf_dir).select("id_str", "tweet")
    tokens = stored(views.vocabulary(clean_posts(posts)), "vocabulary")
    stemmed = clean_posts(posts, CleanConfig(stem=True), stems=views.suffix_stems(tokens))
    return stemmed.select("id_str", "clean")


@query
def dedup_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = views.posts(spark, sf_dir).select("id_str", "tweet", "seq")
    return corpus.distinct_texts(clean_posts(posts)).select("id_str", "clean")


@query
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes along the way: posts, cleaned, distinct, words, tokens after phrases."""
    posts = views.posts(spark, sf_dir).select("id_str", "tweet", "seq")
    texts = _texts(spark, sf_dir)
    docs = texts.select("id_str", text.split_words(F.col("clean")).alias("words"))
    merged = phrases.merge_phrases(docs, phrases.phrase_scores(texts))
    empty = F.count_if(F.col("clean") == "")
    return reduce(
        DataFrame.unionByName,
        [
            corpus.metric(posts, "posts"),
            corpus.metric(clean_posts(posts), "cleaned_posts", F.count("clean")),
            corpus.metric(texts, "distinct_texts"),
            corpus.metric(texts, "empty_texts", empty),
            corpus.metric(corpus.word_counts(docs), "distinct_words"),
            corpus.metric(corpus.word_counts(docs, 4), "vocabulary_min_count_4"),
            corpus.metric(merged, "tokens_after_phrases", F.sum(F.size("words"))),
        ],
    )


@query
def vocabulary_min_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir).select(text.split_words(F.col("clean")).alias("words"))
    return corpus.word_counts(docs, WordVectorConfig().min_count)


# --------------------------------------------------------------------------- ingest


@query
def status_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its fields or the reason it was rejected."""
    parsed = news_source.parse_status(views.status_lines(views.news(spark, sf_dir)))
    good = F.col("reject").isNull()
    return parsed.select(
        F.when(good, F.col("id_str")).alias("id_str"),
        F.when(good, F.col("tweet")).alias("tweet"),
        F.when(good, F.col("ctime")).alias("ctime"),
        F.when(good, F.col("rt_cnt")).alias("rt_cnt"),
        F.coalesce("reject", F.lit("accepted")).alias("outcome"),
    )


@query
def news_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table holding the English posts, then a load of all posts with other repost counts."""
    rows = views.news(spark, sf_dir)
    path = scratch_path(spark, "news")
    first = views.status_lines(rows.filter(F.col("lang") == "en"))
    for load, lines in enumerate([first, views.status_lines(rows, extra_reposts=1)]):
        ingest.ingest_batch(lines, path, load=load, arrival=())
    return news_source.read_news(spark, path).select("id_str", "tweet", "ctime", "rt_cnt")


@query
def news_upsert_moved_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `news_upsert`, but the second load carries other days and unreadable times."""
    rows = views.news(spark, sf_dir)
    path = scratch_path(spark, "news")
    moved = F.when(F.col("seq") % 2 == 0, "no time").otherwise("Sun Jan 01 00:00:00 +0000 2017")
    first = views.status_lines(rows.filter(F.col("lang") == "en"))
    second = views.status_lines(rows.withColumn("ctime", moved), extra_reposts=1)
    for load, lines in enumerate([first, second]):
        ingest.ingest_batch(lines, path, load=load, arrival=())
    return news_source.read_news(spark, path).select("id_str", "tweet", "ctime", "rt_cnt")


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses land as files, are streamed in, land again with other counts after a restart."""
    rows = views.news(spark, sf_dir)
    base = scratch_path(spark, "stream")
    landing, table, checkpoint = f"{base}/landing", f"{base}/news", f"{base}/checkpoint"
    first = views.status_lines(rows.filter(F.col("lang") == "en"))
    for lines in (first, views.status_lines(rows, extra_reposts=1)):
        lines.write.mode("append").text(landing)
        source = ingest.landed_stream(spark, landing)
        run = ingest.ingest_stream(source, table, checkpoint, f"{base}/rejects", available_now=True)
        run.awaitTermination()
    return news_source.read_news(spark, table).select("id_str", "tweet", "ctime", "rt_cnt")


@query
def news_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.news(spark, sf_dir)
    created = F.unix_timestamp(text.status_time(F.col("ctime"))).alias("created_epoch")
    return rows.select("id_str", "tweet", "ctime", "rt_cnt", created)


# ----------------------------------------------------------------- terms and phrases


@query
def idf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, terms = plan.corpus_terms(_texts(spark, sf_dir))
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def tfidf_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, terms = plan.corpus_terms(_texts(spark, sf_dir))
    weights = features.tfidf_long(words, terms)
    return weights.select("id_str", "term", F.round("weight", 6).alias("weight"))


@query
def term_counts_500(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = TopicConfig()
    docs = _texts(spark, sf_dir).select("id_str", text.split_words(F.col("clean")).alias("words"))
    terms = features.frequent_terms(docs, cfg.min_df, cfg.max_features)
    return features.term_count_long(docs, terms)


@query
def phrase_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = phrases.phrase_scores(_texts(spark, sf_dir))
    return scored.select("a", "b", "n", F.round("score", 4).alias("score"))


@query
def phrase_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    docs = texts.select("id_str", text.split_words(F.col("clean")).alias("words"))
    merged = phrases.merge_phrases(docs, phrases.phrase_scores(texts))
    return merged.select("id_str", text.joined(F.col("words")).alias("phrased"))


@query
def turn_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of the conversation turns, a second corpus."""
    turns = views.table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id_str"),
        F.col("text").alias("tweet"),
        F.struct("conv_id", "turn").alias("seq"),
    )
    scored = phrases.phrase_scores(plan.build_corpus(turns), PhraseConfig())
    return scored.select("a", "b", "n", F.round("score", 4).alias("score"))


# ------------------------------------------------------------- distances and ranking


def _label_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(cluster.mean_centres(views.vectors(spark, sf_dir), "cluster", "vector"), "centres")


def _label_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.vectors(spark, sf_dir)
    return cluster.own_distances(rows, _label_centres(spark, sf_dir), "vector")


@query
def centroid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _label_members(spark, sf_dir)
    return members.select("vec_id", "cluster", F.round("dist", 4).alias("dist"))


@query
def all_centroid_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = [(r["cluster"], r["centre"]) for r in _label_centres(spark, sf_dir).collect()]
    measured = cluster.all_distances(views.vectors(spark, sf_dir), centres, "vector")
    ids = F.array(*[F.lit(c) for c, _ in sorted(centres)])
    long = measured.select("vec_id", F.posexplode("distances").alias("pos", "d"))
    return long.select(
        "vec_id", F.get(ids, F.col("pos")).alias("cluster"), F.round("d", 4).alias("dist")
    )


def _thirty(spark: SparkSession, sf_dir: str, order: str) -> DataFrame:
    members = _label_members(spark, sf_dir).drop("vector")
    chosen = rank.candidates(members, RankConfig(order=order))
    return chosen.select("cluster", "vec_id", "dist_rank", text.fixed3(F.col("dist")).alias("dist"))


@query
def farthest30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thirty(spark, sf_dir, "farthest")


@query
def nearest30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thirty(spark, sf_dir, "nearest")


@query
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of each cluster with their distance text and the size of the cluster."""
    members = _label_members(spark, sf_dir)
    return lookup(members, cluster.cluster_sizes(members), ["cluster"]).select(
        "cluster", "vec_id", text.fixed3(F.col("dist")).alias("dist"), "n_members"
    )


@query
def hot_clusters_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    reposts = views.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("vec_id"), F.floor("value").cast("int").alias("rt_cnt")
    )
    labelled = views.vectors(spark, sf_dir).select("vec_id", "cluster")
    return rank.top_events(labelled.join(reposts, "vec_id"))


def _source_clusters(spark: SparkSession, sf_dir: str, lemmatise: bool = False):
    """Corpus with the source as cluster: (texts, terms, tags, members)."""
    rows = views.news(spark, sf_dir).select("id_str", "tweet", "seq", "source", "rt_cnt")
    if lemmatise:
        texts = plan.build_corpus(rows, WHOLE_JOB, lemmas=_lexicons(rows)[0])
    else:
        texts = plan.build_corpus(rows)
    words, terms = plan.corpus_terms(texts)
    labelled = texts.select("id_str", "seq", "rt_cnt", F.col("source").alias("cluster"))
    weights = features.tfidf_long(words, terms)
    members = stored(cluster.term_space_distances(weights, labelled), "members")
    return texts, terms, _tags(texts), members


def _tags(texts: DataFrame) -> DataFrame:
    docs = texts.select(text.split_words(F.col("clean")).alias("words"))
    return stored(views.suffix_tags(views.vocabulary(docs)), "tags")


@query
def post_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    _, terms = plan.corpus_terms(texts)
    scores = rank.post_scores(texts, rank.kept_terms(terms, _tags(texts)))
    return scores.select("id_str", F.round("score", 6).alias("score"))


@query
def source_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each post to the centre of its source in the term space."""
    _, _, _, members = _source_clusters(spark, sf_dir)
    return members.select("cluster", "id_str", F.round("dist", 4).alias("dist"))


@query
def cluster_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, terms, tags, members = _source_clusters(spark, sf_dir)
    best = rank.winners(plan.scored_candidates(members, texts, terms, tags))
    return best.select("cluster", "id_str", "dist_rank", F.round("score", 6).alias("score"))


@query
def hot_news_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final report with the source as cluster, with lemmas and tags."""
    texts, terms, tags, members = _source_clusters(spark, sf_dir, lemmatise=True)
    final = plan.rank_posts(members, texts, terms, views.news(spark, sf_dir), tags)
    return report_lines(final).select("event_rank", "cluster", "rt_sum", "id_str", "rt_cnt", "line")


# --------------------------------------------------------------------------- models


@query
def hot_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job with lemmas and tags: clean, weigh, reduce, cluster, rank."""
    rows = views.news(spark, sf_dir).select("id_str", "tweet", "ctime", "rt_cnt", "seq")
    lemmas, tags = _lexicons(rows.select("id_str", "tweet"))
    return plan.hot_news(rows, WHOLE_JOB, lemmas, tags)


def _clustered(spark: SparkSession, sf_dir: str) -> plan.Clustered:
    rows = views.news(spark, sf_dir).select("id_str", "tweet", "rt_cnt", "seq")
    return plan.cluster_posts(plan.build_corpus(rows))


@query
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir).members.select("id_str", "cluster", "dist")


@query
def cluster_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _clustered(spark, sf_dir)
    return cluster.cluster_top_terms(found.space.basis, found.centres)


@query
def lsa_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    words, terms = plan.corpus_terms(texts)
    return lsa.fit_lsa(words, terms).rows


def _topics(spark: SparkSession, sf_dir: str) -> topics.Topics:
    docs = _texts(spark, sf_dir).select("id_str", text.split_words(F.col("clean")).alias("words"))
    return topics.fit_topics(docs)


@query
def lda_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.topic_words(_topics(spark, sf_dir))


@query
def lda_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.topic_mix(_topics(spark, sf_dir)).select("id_str", "topic", "mix")


def _sentences(spark: SparkSession, sf_dir: str, phrased: bool) -> DataFrame:
    texts = _texts(spark, sf_dir)
    docs = texts.select("id_str", text.split_words(F.col("clean")).alias("words"))
    if not phrased:
        return docs
    return stored(phrases.merge_phrases(docs, phrases.phrase_scores(texts)), "sentences")


@query
def similar_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest words of the six most frequent words, over phrase-merged text."""
    sentences = _sentences(spark, sf_dir, phrased=True)
    vectors = embed.fit_word_vectors(sentences)
    common = corpus.word_counts(sentences).orderBy(F.col("count").desc(), "word").limit(6)
    return embed.similar_words(vectors, [r["word"] for r in common.collect()])


@query
def cooccurrence_ppmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive pointwise information of word pairs, the matrix the word vectors come from."""
    values, _ = embed.pointwise_information(_sentences(spark, sf_dir, phrased=False))
    return values.select("a", "b", F.round("value", 4).alias("value"))


@query
def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _sentences(spark, sf_dir, phrased=False)
    return embed.document_vectors(embed.fit_word_vectors(docs), docs)


@query
def pca_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.vectors(spark, sf_dir).select("vec_id", "vector")
    return lsa.unit_principal_components(rows, "vector", 10).select("vec_id", "pca")


@query
def map_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat map of vectors with their label."""
    rows = views.vectors(spark, sf_dir).select("vec_id", "cluster", "vector")
    return lsa.flat_map(rows, "vector")


@query
def map_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat map of the distances to the centres of a k-means model."""
    rows = views.vectors(spark, sf_dir).select("vec_id", "vector")
    model = cluster.fit_kmeans(rows, "vector", ClusterConfig())
    members = cluster.assign(model, rows, "vector")
    centres = [(i, list(c)) for i, c in enumerate(model.clusterCenters())]
    measured = cluster.all_distances(members, centres, "vector")
    return lsa.flat_map(measured.select("vec_id", "cluster", "distances"), "distances")


# ------------------------------------------- model steps and invariants that SQL can check


@query
def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of k-means from the centres of the labels: new centre of each vector's cluster."""
    centres = [(r["cluster"], r["centre"]) for r in _label_centres(spark, sf_dir).collect()]
    measured = cluster.all_distances(views.vectors(spark, sf_dir), centres, "vector")
    ids = F.array(*[F.lit(c) for c, _ in sorted(centres)])
    nearest = F.get(ids, vectors.argmax(F.transform("distances", lambda d: -d)))
    moved = cluster.mean_centres(measured.withColumn("nearest", nearest), "nearest", "vector")
    long = moved.select("cluster", F.posexplode("centre").alias("i", "v"))
    return long.select("cluster", "i", F.round("v", 4).alias("v"))


@query
def lsa_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with a vocabulary term have a unit row, others a zero row."""
    norm = F.round(vectors.l2_norm(F.col("lsa")), 6).alias("norm")
    return lsa_rows(spark, sf_dir).select("id_str", norm)


@query
def kmeans_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post of the corpus has one of the clusters and a distance."""
    known = F.col("cluster").between(0, ClusterConfig().k - 1) & (F.col("dist") >= 0)
    return kmeans_assign(spark, sf_dir).agg(
        F.count("*").alias("posts"), F.count_if(known).alias("clustered"),
        F.count_distinct("id_str").alias("ids"),
    )


@query
def cluster_term_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_top_terms(spark, sf_dir).select("cluster", "rank")


@query
def topic_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with one of the topic terms have a topic; the shares add up to one."""
    total = F.aggregate("mix", F.lit(0.0), lambda a, b: a + b)
    whole = F.round(total, 6).alias("total")
    return lda_assign(spark, sf_dir).select("id_str", whole)


@query
def topic_word_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lda_topics(spark, sf_dir).select("topic", "rank")


@query
def vector_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words counted often enough have a vector; it has length one unless nothing is known of it."""
    found = embed.fit_word_vectors(_sentences(spark, sf_dir, phrased=False))
    return found.select("word", F.size("vector").alias("width"))
