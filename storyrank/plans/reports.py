"""The whole job with every report written out.

    spark-submit ... -m storyrank.plans.reports NEWS OUTPUT [--lemmas TABLE] [--tags TABLE] [--examples WORD ...]

LEMMAS holds (token, pos, lemma), TAGS holds (token, tag), both as Parquet.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyrank.config import CleanConfig, PipelineConfig, TopicConfig
from storyrank.functions import text
from storyrank.operators import cluster, corpus, embed, lsa, phrases, rank, topics
from storyrank.operators.clean import clean_posts
from storyrank.plans import hot_news as plan
from storyrank.sources import models, reports
from storyrank.sources.corpus import write_cleaned
from storyrank.sources.news import read_news
from storyrank.sources.scratch import drop_scratch, stored


def write_reports(
    news: DataFrame,
    out: str,
    cfg: PipelineConfig = PipelineConfig(),
    lemmas: DataFrame | None = None,
    tags: DataFrame | None = None,
) -> plan.Clustered:
    """Write cleaned posts, cluster members, top terms, scored posts, winners and final posts.

    Returns the clustered posts, which `write_side_branches` goes on from.
    """
    posts = news.select("id_str", "tweet", "rt_cnt", "seq")
    cleaned = stored(clean_posts(posts, cfg.clean, lemmas=lemmas, lookup_cfg=cfg.lookup), "cleaned")
    write_cleaned(cleaned, f"{out}/cleaned")

    texts = stored(corpus.distinct_texts(cleaned), "corpus")
    found = plan.cluster_posts(texts, cfg)
    listed = found.members.join(texts.select("id_str", "clean"), "id_str")
    reports.write_cluster_members(listed, f"{out}/cluster_members")
    reports.write_top_terms(
        cluster.cluster_top_terms(found.space.basis, found.centres), f"{out}/cluster_terms"
    )

    scored = stored(plan.scored_candidates(found.members, texts, found.terms, tags, cfg), "scored")
    reports.write_scored_posts(scored, f"{out}/scored_posts")

    best = rank.winners(scored)
    # one row per cluster
    chosen = news.join(F.broadcast(best.select("id_str", "cluster")), "id_str")
    reports.write_posts(chosen, f"{out}/cluster_winners", [F.col("cluster")])
    final = rank.hot_posts(best, rank.top_events(found.members, cfg.rank), news)
    reports.write_posts(final, f"{out}/final_posts", [F.col("event_rank")])
    return found


def write_side_branches(
    found: plan.Clustered, out: str, cfg: PipelineConfig = PipelineConfig(), examples: Sequence[str] | None = None
) -> None:
    """Write what the job makes beside its answer: topics, similar words, maps and the models.

    `examples` are the words to look up, the six most frequent unless given. Maps are (.., x, y)
    tables of posts by their reduced rows, by distances to the centres and by topic mix, and of
    words by both sets of vectors, those of plain and of phrase-merged texts. Models go to versioned
    folders, for `load_model`.
    """
    spark = found.corpus.sparkSession
    docs = found.corpus.select("id_str", text.split_words(F.col("clean")).alias("words"))

    fitted = topics.fit_topics(docs)
    every = stored(topics.topic_words(fitted, len(fitted.vocabulary)), "topic-terms")
    listed = topics.heaviest_words(every, TopicConfig().words_per_topic)
    reports.write_top_terms(listed.withColumnRenamed("topic", "cluster"), f"{out}/topic_words")
    mix = stored(topics.topic_mix(fitted), "topic-mix")
    mix.write.mode("overwrite").parquet(f"{out}/topic_mix")

    merged = phrases.merge_phrases(docs, phrases.phrase_scores(found.corpus))
    vectors = {}
    for name, sentences in (("words", docs), ("phrases", stored(merged, "sentences"))):
        vectors[name] = embed.fit_word_vectors(sentences, lookup_cfg=cfg.lookup)
        wanted = examples
        if wanted is None:
            common = corpus.word_counts(sentences).orderBy(F.col("count").desc(), "word").limit(6)
            wanted = [r["word"] for r in common.collect()]
        similar = embed.similar_words(vectors[name], wanted)
        similar.write.mode("overwrite").parquet(f"{out}/similar_{name}")

    rows = stored(found.space.rows, "lsa-rows")
    centres = found.centres.select("cluster", "centre").orderBy("cluster").collect()  # k rows
    measured = cluster.all_distances(rows, [(r["cluster"], r["centre"]) for r in centres], "lsa")
    maps = {
        "posts": lsa.flat_map(rows.select("id_str", "lsa"), "lsa"),
        "distances": lsa.flat_map(measured.select("id_str", "distances"), "distances"),
        "topics": lsa.flat_map(mix.select("id_str", "topic", "mix"), "mix"),
        "words": lsa.flat_map(vectors["words"], "vector"),
        "phrases": lsa.flat_map(vectors["phrases"], "vector"),
    }
    for name, table in maps.items():
        table.write.mode("overwrite").parquet(f"{out}/map_{name}")

    saved = {
        "lsa": {"terms": found.terms.select("term", "idf"), "basis": found.space.basis},
        "centres": {"centres": found.centres},
        "topics": {"topics": every.select("topic", "term", "weight")},
        "words": {"vectors": vectors["words"]},
        "phrases": {"vectors": vectors["phrases"]},
    }
    for name, tables in saved.items():
        models.save_model(spark, f"{out}/models/{name}", tables)


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("news")
    parser.add_argument("output")
    parser.add_argument("--lemmas")
    parser.add_argument("--tags")
    parser.add_argument("--examples", nargs="*")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("storyrank").getOrCreate()
    lemmas, tags = (spark.read.parquet(p) if p else None for p in (args.lemmas, args.tags))
    cfg = PipelineConfig(clean=CleanConfig(lemmatise=lemmas is not None))
    found = write_reports(read_news(spark, args.news), args.output, cfg, lemmas, tags)
    write_side_branches(found, args.output, cfg, args.examples)
    drop_scratch(spark)


if __name__ == "__main__":
    main()
