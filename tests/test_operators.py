from __future__ import annotations

import math
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyrank.config import LookupConfig, PhraseConfig, RankConfig, TfIdfConfig
from storyrank.functions import text
from storyrank.operators import cluster, corpus, features, lexicon, phrases, rank
from storyrank.operators.lookup import lookup, split_join
from storyrank.operators.topk import top_per_group

# a bound this low takes the split layout: at most one hot key is broadcast, the rest shuffled
NEVER_BROADCAST = LookupConfig(max_broadcast_rows=2)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def docs_of(spark, texts):
    data = [(str(i), i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "id_str string, seq long, clean string")


def random_texts(n, words, length, seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    return [" ".join(draw.choices(vocabulary, k=draw.randint(1, length))) for _ in range(n)]


def test_distinct_texts_keep_the_first_in_order(spark):
    data = [("9", 9, "a b"), ("5", 5, "a b"), ("7", 7, ""), ("8", 8, ""), ("6", 6, "c")]
    df = spark.createDataFrame(data, "id_str string, seq long, clean string")
    got = corpus.distinct_texts(df).select("id_str", "clean")
    assert rows(got) == [("5", "a b"), ("6", "c"), ("7", "")]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_layouts_agree(spark, how):
    facts = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(90)], "id int, k string")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 90, 6)], "k string, v int")
    plain = rows(facts.join(table, "k", how).select("id", "k", "v").na.fill(-1))
    for cfg in (LookupConfig(), NEVER_BROADCAST):
        assert rows(lookup(facts, table, ["k"], cfg, how).select("id", "k", "v").na.fill(-1)) == plain


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("max_hot", [0, 2, 10])
def test_split_join_of_hot_and_missing_keys(spark, how, max_hot):
    facts = spark.range(900).select(
        "id",
        F.when(F.col("id") < 400, "hot").when(F.col("id") < 700, "hot, missing")
        .otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
    )
    table = spark.createDataFrame([("hot", -1)] + [(f"k{i}", i) for i in range(0, 50, 2)], "k string, v int")
    want = rows(facts.join(table, "k", how).select("id", "k", "v").na.fill(-9))
    got = split_join(facts, table, ["k"], max_hot, how)
    assert rows(got.select("id", "k", "v").na.fill(-9)) == want


def test_replace_words_layouts_agree(spark):
    # ids repeat and are null: each row keeps its own words
    df = spark.createDataFrame(
        [("1", 1, ["b", "a", "b"]), ("2", 2, []), ("3", 3, ["z", "a"]), ("1", 4, ["b"]), (None, 5, ["a"]), (None, 6, [])],
        "id_str string, seq int, words array<string>",
    ).repartition(3)
    table = spark.createDataFrame([("a", "x"), ("b", "y")], "token string, replacement string")
    want = [
        ("1", 1, ["y", "x", "y"]), ("2", 2, []), ("3", 3, ["z", "x"]), ("1", 4, ["y"]), (None, 5, ["x"]), (None, 6, []),
    ]
    for cfg in (LookupConfig(), NEVER_BROADCAST):
        got = lexicon.replace_words(df, table, cfg).orderBy("seq").select("id_str", "seq", "words")
        assert [tuple(r) for r in got.collect()] == want


def test_top_per_group_with_a_hot_group(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 2500, 0).otherwise(F.col("id") % 5).cast("int").alias("g"),
        ((F.col("id") * 7919) % 1000).alias("v"),
        "id",
    )
    order = [F.col("v").desc(), F.col("id")]
    want = rows(top_per_group(df, "g", order, 4))
    assert rows(top_per_group(df, "g", order, 4, spread_on="id").select("g", "v", "id", "rank")) == want
    assert len(want) == 20


def test_idf_bounds_and_formula(spark):
    texts = ["a b", "a b", "a c", "a d"]
    words = features.tfidf_words(docs_of(spark, texts), TfIdfConfig(stop_words=()))
    got = {r["term"]: (r["df"], r["idf"]) for r in features.term_stats(words, 4, TfIdfConfig(min_df=2)).collect()}
    # `a` is in more than half of the texts, `c` and `d` in too few
    assert set(got) == {"b"}
    assert got["b"][0] == 2
    assert got["b"][1] == pytest.approx(math.log(5 / 3) + 1)


def test_tfidf_forms_agree(spark):
    texts = random_texts(60, 30, 25, seed=1) + ["unknown"]
    words = features.tfidf_words(docs_of(spark, texts), TfIdfConfig(stop_words=()))
    terms = features.term_stats(words, len(texts), TfIdfConfig(min_df=2, max_df=0.9))
    long = {(r["id_str"], r["term"]): r["weight"] for r in features.tfidf_long(words, terms).collect()}
    salted = features.tfidf_long(words, terms, NEVER_BROADCAST)
    assert {(r["id_str"], r["term"]): r["weight"] for r in salted.collect()} == pytest.approx(long)
    vocabulary = terms.select("term", "idf").orderBy("term").toArrow()
    names = vocabulary["term"].to_pylist()
    sparse = features.tfidf_rows(words, vocabulary).collect()
    assert {(r["id_str"], names[i]): v for r in sparse for i, v in zip(r["idx"], r["val"])} == pytest.approx(long)
    assert {r["id_str"]: len(r["idx"]) for r in sparse}["60"] == 0


def test_posts_are_dealt_whole_and_their_terms_do_not_move(spark):
    """Also where an id is repeated: its rows share one length."""
    docs = spark.createDataFrame([("1", ["a", "b"]), ("1", ["b"]), ("2", ["b"]), (None, ["a"])], "id_str string, words array<string>")
    terms = spark.createDataFrame([("a", 3.0), ("b", 2.0)], "term string, idf double")
    found = features.tfidf_long(docs, terms)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan[: plan.index("Generate")]
    length = math.sqrt(9 + 4 + 4)
    got = sorted((r["id_str"] or "", r["term"], r["weight"]) for r in found.collect())
    want = [("", "a", 1.0), ("1", "a", 3 / length), ("1", "b", 2 / length), ("1", "b", 2 / length), ("2", "b", 1.0)]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_post_score(spark):
    posts = spark.createDataFrame([("1", "a b b c"), ("2", "")], "id_str string, clean string")
    terms = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "term string, idf double")
    all_kept = rank.kept_terms(terms, None)
    assert rows(rank.post_scores(posts, all_kept)) == [("1", 1.25)]
    tags = spark.createDataFrame([("b", "JJ")], "token string, tag string")
    assert rows(rank.post_scores(posts, rank.kept_terms(terms, tags))) == [("1", 0.25)]


def test_candidate_order_and_ties(spark):
    data = [(0, "1", 1, 0.1234), (0, "2", 2, 0.1231), (0, "3", 3, 0.9), (0, "4", 4, 0.05)]
    members = spark.createDataFrame(data, "cluster int, id_str string, seq long, dist double")

    def ids(order):
        got = rank.candidates(members, RankConfig(order=order, candidates=3)).orderBy("dist_rank")
        return [r["id_str"] for r in got.collect()]

    assert ids("farthest") == ["3", "1", "2"]
    assert ids("nearest") == ["4", "1", "2"]
    with pytest.raises(ValueError):
        rank.candidates(members, RankConfig(order="middle"))


def test_hot_cluster_ties_go_to_the_smaller_cluster(spark):
    members = spark.createDataFrame([(3, 5), (1, 5), (2, 4), (1, 0)], "cluster int, rt_cnt int")
    got = rank.top_events(members).orderBy("event_rank").collect()
    assert [(r["cluster"], r["rt_sum"]) for r in got] == [(1, 5), (3, 5)]


def test_term_space_distance_against_dense(spark):
    texts = random_texts(40, 12, 10, seed=3)
    words = features.tfidf_words(docs_of(spark, texts), TfIdfConfig(stop_words=()))
    terms = features.term_stats(words, len(texts), TfIdfConfig(min_df=2, max_df=1.0))
    weights = features.tfidf_long(words, terms)
    members = docs_of(spark, texts).select("id_str", (F.col("seq") % 3).cast("int").alias("cluster"))
    table = {}
    for r in weights.collect():
        table.setdefault(r["id_str"], {})[r["term"]] = r["weight"]
    groups = {c: [table.get(str(i), {}) for i in range(40) if i % 3 == c] for c in range(3)}
    mean = {
        c: {t: sum(x.get(t, 0) for x in g) / len(g) for t in {t for x in g for t in x}} for c, g in groups.items()
    }
    for cfg in (LookupConfig(), NEVER_BROADCAST):
        for r in cluster.term_space_distances(weights, members, cfg).collect():
            x, c = table.get(r["id_str"], {}), mean[r["cluster"]]
            want = math.sqrt(sum((x.get(t, 0) - c.get(t, 0)) ** 2 for t in set(x) | set(c)))
            assert r["dist"] == pytest.approx(want, abs=1e-7)


def greedy(words, accepted):
    out, i = [], 0
    while i < len(words):
        if i + 1 < len(words) and (words[i], words[i + 1]) in accepted:
            out.append(words[i] + "_" + words[i + 1])
            i += 2
        else:
            out.append(words[i])
            i += 1
    return out


@pytest.mark.parametrize("cfg", [LookupConfig(), NEVER_BROADCAST])
def test_phrase_merge_reads_greedily(spark, cfg):
    texts = ["a b c d", "x a b", "a a a a a", "solo", ""] + random_texts(30, 4, 12, seed=5)
    accepted = {("a", "b"), ("b", "c"), ("c", "d"), ("a", "a"), ("w1", "w2"), ("w2", "w2"), ("w2", "w3")}
    pairs = spark.createDataFrame(sorted(accepted), "a string, b string")
    docs = docs_of(spark, texts).select("id_str", text.split_words(F.col("clean")).alias("words"))
    got = {r["id_str"]: r["words"] for r in phrases.merge_phrases(docs, pairs, lookup_cfg=cfg).collect()}
    # posts without words keep their row
    assert got == {str(i): greedy(t.split(), accepted) for i, t in enumerate(texts)}
    assert got["0"] == ["a_b", "c_d"]


def test_phrase_scores_against_counting(spark):
    texts = random_texts(50, 6, 20, seed=7) + [""]
    single, pair = {}, {}
    for t in texts:
        words = t.split(" ")
        for w in words:
            single[w] = single.get(w, 0) + 1
        for p in zip(words, words[1:]):
            pair[p] = pair.get(p, 0) + 1
    total = len(single) + len(pair)
    cfg = PhraseConfig(threshold=0.02)
    want = {}
    for (a, b), n in pair.items():
        score = (n - 4) * total / (single[a] * single[b])
        if n >= 4 and score > 0.02:
            want[a, b] = score
    for lookup_cfg in (LookupConfig(), NEVER_BROADCAST):
        got = phrases.phrase_scores(docs_of(spark, texts), cfg, lookup_cfg)
        assert {(r["a"], r["b"]): r["score"] for r in got.collect()} == pytest.approx(want)
    assert want


def test_texts_of_a_batch_are_read_a_few_at_a_time():
    texts = [[f"w{i % 7}", "a", "b", *(f"x{i}y{j}" for j in range(100))] for i in range(3_000)] + [None, []]
    want = [[t[0], "a_b", *t[3:]] if t else [] for t in texts]
    words = pa.array(texts, pa.list_(pa.string()))
    tracemalloc.start()
    got = phrases._read_texts(words, {("a", "b")}, "_")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == want
    assert peak < 4_000_000
