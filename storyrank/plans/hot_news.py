"""From the news table to the hot posts."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyrank.config import PipelineConfig
from storyrank.operators import corpus, features, kmeans, lsa, rank
from storyrank.operators.clean import clean_posts
from storyrank.sources.scratch import discard, stored


@dataclass(frozen=True)
class Clustered:
    """Corpus, term table, reduced space and clustered posts of one run."""

    corpus: DataFrame
    terms: DataFrame
    space: lsa.Lsa
    centres: DataFrame
    members: DataFrame


def build_corpus(
    news: DataFrame,
    cfg: PipelineConfig = PipelineConfig(),
    stems: DataFrame | None = None,
    lemmas: DataFrame | None = None,
) -> DataFrame:
    """Clean the posts and keep the first of each distinct text; stored in scratch."""
    cleaned = clean_posts(news, cfg.clean, stems, lemmas, lookup_cfg=cfg.lookup)
    return stored(corpus.distinct_texts(cleaned), "corpus")


def corpus_terms(texts: DataFrame, cfg: PipelineConfig = PipelineConfig()) -> tuple[DataFrame, DataFrame]:
    """(words, terms) of a stored corpus; the term table is stored too."""
    words = features.tfidf_words(texts, cfg.tfidf)
    return words, stored(features.term_stats(words, texts.count(), cfg.tfidf), "terms")


def cluster_posts(texts: DataFrame, cfg: PipelineConfig = PipelineConfig()) -> Clustered:
    """TF-IDF, LSA and k-means over a stored corpus (id_str, seq, rt_cnt, clean)."""
    _, terms = corpus_terms(texts, cfg)
    second = features.text.without(features.text.split_words(F.col("clean")), cfg.tfidf.stop_words)
    words = texts.select("id_str", "seq", "rt_cnt", second.alias("words"))
    space = lsa.fit_lsa(words, terms, cfg.lsa, cfg.lookup)
    rows = stored(space.rows, "lsa-rows")
    discard(*space.parts)
    space = replace(space, rows=rows, parts=())
    model = kmeans.fit(rows, "id_str", "lsa", cfg.cluster)
    members = kmeans.assign(model, rows, "lsa").drop("lsa")
    return Clustered(texts, terms, space, model.frame(rows.sparkSession), stored(members, "members"))


def scored_candidates(
    members: DataFrame,
    texts: DataFrame,
    terms: DataFrame,
    tags: DataFrame | None = None,
    cfg: PipelineConfig = PipelineConfig(),
) -> DataFrame:
    """Candidates of each cluster with their score; a few posts per cluster."""
    chosen = stored(rank.candidates(members, cfg.rank), "candidates")
    ids = chosen.select("id_str")
    few = ids.count() <= cfg.lookup.max_broadcast_rows
    posts = texts.select("id_str", "clean").join(F.broadcast(ids) if few else ids, "id_str")
    scores = rank.post_scores(posts, rank.kept_terms(terms, tags, cfg.rank), cfg.lookup)
    return chosen.join(scores, "id_str")


def rank_posts(
    members: DataFrame,
    texts: DataFrame,
    terms: DataFrame,
    news: DataFrame,
    tags: DataFrame | None = None,
    cfg: PipelineConfig = PipelineConfig(),
) -> DataFrame:
    """Best post of each of the hottest clusters."""
    best = rank.winners(scored_candidates(members, texts, terms, tags, cfg))
    return rank.hot_posts(best, rank.top_events(members, cfg.rank), news)


def hot_news(
    news: DataFrame,
    cfg: PipelineConfig = PipelineConfig(),
    lemmas: DataFrame | None = None,
    tags: DataFrame | None = None,
) -> DataFrame:
    """(event_rank, cluster, rt_sum, id_str, tweet, ctime, rt_cnt, score) of the hot posts.

    `news` has id_str, tweet, ctime, rt_cnt and an order column seq.
    """
    posts = news.select("id_str", "tweet", "rt_cnt", "seq")
    texts = build_corpus(posts, cfg, lemmas=lemmas)
    found = cluster_posts(texts, cfg)
    return rank_posts(found.members, found.corpus, found.terms, news, tags, cfg)
