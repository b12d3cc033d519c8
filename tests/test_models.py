from __future__ import annotations

import random

import numpy as np
import pytest

from storyrank.config import ClusterConfig, LookupConfig, LsaConfig, TfIdfConfig, TopicConfig, WordVectorConfig
from storyrank.operators import cluster, embed, features, lsa, topics
from storyrank.plans import queries, views


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts around six themes, plus one text without any vocabulary term."""
    draw = random.Random(11)
    themes = [[f"t{k}w{i}" for i in range(12)] for k in range(6)]
    common = [f"c{i}" for i in range(20)]
    data = []
    for n in range(150):
        words = draw.choices(themes[n % 6], k=8) + draw.choices(common, k=4)
        data.append((str(n), words))
    data.append(("150", ["zzz"]))
    return spark.createDataFrame(data, "id_str string, words array<string>").repartition(4, "id_str").cache()


@pytest.fixture(scope="module")
def terms(corpus):
    return features.term_stats(corpus, 151, TfIdfConfig(min_df=2, max_df=0.9)).cache()


def dense_tfidf(corpus, terms):
    vocabulary = terms.select("term", "idf").orderBy("idf", "term").toArrow()
    a = np.zeros((151, vocabulary.num_rows))
    for r in features.tfidf_rows(corpus, vocabulary).collect():
        a[int(r["id_str"]), r["idx"]] = r["val"]
    return a


CFG = LsaConfig(components=8, oversample=10, rounds=6)


def space(corpus, terms, blocks, lookup_cfg=LookupConfig(), rounds=6):
    """Singular values, rows in order of id and loadings by term, with the basis in so many blocks."""
    width, n = min(18, terms.count()), terms.count()
    cfg = LsaConfig(components=8, oversample=10, rounds=rounds, max_block_bytes=-(-n // blocks) * width * 8)
    found = lsa.fit_lsa(corpus, terms, cfg, lookup_cfg)
    rows = {int(r["id_str"]): r["lsa"] for r in found.rows.collect()}
    basis = {r["term"]: r["loading"] for r in found.basis.collect()}
    return found.singular_values, np.array([rows[i] for i in sorted(rows)]), np.array([basis[t] for t in sorted(basis)])


def test_lsa_matches_an_exact_svd(corpus, terms):
    values, rows, basis = space(corpus, terms, 1)
    a = dense_tfidf(corpus, terms)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.all(np.diff(values) <= 1e-9)
    assert values[:6] == pytest.approx(s[:6], rel=1e-4)
    norms = np.linalg.norm(rows, axis=1)
    assert norms[:150] == pytest.approx(1.0) and norms[150] == 0
    assert basis.T @ basis == pytest.approx(np.eye(8), abs=1e-9)


@pytest.mark.parametrize("blocks, bound", [(3, 1_000_000), (20, 1_000_000), (3, 5)])
@pytest.mark.parametrize("rounds", [1, LsaConfig().rounds])
def test_lsa_is_the_same_in_any_number_of_blocks(corpus, terms, blocks, bound, rounds):
    one_values, one_rows, one_basis = space(corpus, terms, 1, rounds=rounds)
    values, rows, basis = space(corpus, terms, blocks, LookupConfig(max_broadcast_rows=bound), rounds=rounds)
    assert values == pytest.approx(one_values, rel=1e-6)
    assert rows @ rows.T == pytest.approx(one_rows @ one_rows.T, abs=1e-6)
    assert np.abs((basis * one_basis).sum(axis=0)) == pytest.approx(1.0, abs=1e-6)


@pytest.mark.parametrize("blocks", [1, 4])
def test_lsa_rows_have_the_inner_products_of_the_exact_factors(corpus, terms, blocks):
    """Six themes stand out of the noise: rows in their space do not depend on the solver."""
    n, width = terms.count(), min(18, terms.count())
    cfg = LsaConfig(components=6, oversample=12, rounds=8, max_block_bytes=-(-n // blocks) * width * 8)
    found = lsa.fit_lsa(corpus, terms, cfg)
    rows = {int(r["id_str"]): r["lsa"] for r in found.rows.collect()}
    a = dense_tfidf(corpus, terms)
    _, _, vt = np.linalg.svd(a, full_matrices=False)
    exact = a @ vt[:6].T
    exact /= np.maximum(np.linalg.norm(exact, axis=1, keepdims=True), 1e-300)
    mine = np.array([rows[i] for i in sorted(rows)])
    assert mine @ mine.T == pytest.approx(exact @ exact.T, abs=1e-4)


def test_rows_of_a_large_basis_are_mapped_and_do_not_move(corpus, terms, monkeypatch):
    """Neither cells nor documents are dealt to lanes by block, unless the scratch folder is no mounted one."""
    one = space(corpus, terms, 1, rounds=2)
    monkeypatch.setattr(lsa, "TURNED_PIECES", 2)
    monkeypatch.setattr(lsa, "TURNED_CELLS", 300)
    with monkeypatch.context() as without:
        without.setattr(lsa, "_tiles", None)
        mapped = space(corpus, terms, 3, rounds=2)
    monkeypatch.setattr(lsa.files, "mounted", lambda spark, path: None)
    dealt = space(corpus, terms, 3, rounds=2)
    for values, rows, basis in (mapped, dealt):
        assert values == pytest.approx(one[0], rel=1e-6)
        assert rows @ rows.T == pytest.approx(one[1] @ one[1].T, abs=1e-6)
        assert np.abs((basis * one[2]).sum(axis=0)) == pytest.approx(1.0, abs=1e-6)


def test_a_basis_in_blocks_stays_off_the_driver(corpus, terms, monkeypatch):
    """Only the vocabulary that is proven small may be brought to the driver."""
    n = terms.count()
    cfg = LsaConfig(components=8, oversample=10, rounds=2, max_block_bytes=-(-n // 4) * 18 * 8)
    monkeypatch.setattr(lsa._Basis, "whole", None)
    rows = []
    frame = type(corpus)
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: rows.append(collect(self)) or rows[-1])
    monkeypatch.setattr(frame, "toLocalIterator", None)
    monkeypatch.setattr(frame, "toArrow", None)
    lsa.fit_lsa(corpus, terms, cfg, LookupConfig(max_broadcast_rows=5))
    assert max(map(len, rows)) <= 18


def test_lsa_with_fewer_terms_than_components(spark):
    data = [(str(i), ["a", "b"] if i % 2 else ["a"]) for i in range(10)]
    words = spark.createDataFrame(data, "id_str string, words array<string>")
    terms = features.term_stats(words, 10, TfIdfConfig(min_df=2, max_df=1.0)).cache()
    for bound in (CFG.max_block_bytes, 1):
        found = lsa.fit_lsa(words, terms, LsaConfig(max_block_bytes=bound))
        assert {len(r["lsa"]) for r in found.rows.collect()} == {2}


def test_lsa_is_repeatable(corpus, terms):
    one, two = (
        {r["id_str"]: r["lsa"] for r in lsa.fit_lsa(corpus, terms, CFG).rows.collect()} for _ in range(2)
    )
    assert one.keys() == two.keys()
    for key in one:
        assert one[key] == pytest.approx(two[key], abs=1e-9)


def test_clusters_and_their_terms(corpus, terms):
    space = lsa.fit_lsa(corpus, terms, CFG)
    model = cluster.fit_kmeans(space.rows, "lsa", ClusterConfig(k=7))
    members = cluster.assign(model, space.rows, "lsa")
    centres = model.clusterCenters()
    got = members.collect()
    assert len(got) == 151 and len({r["id_str"] for r in got}) == 151
    for r in got:
        distances = [np.linalg.norm(np.array(r["lsa"]) - c) for c in centres]
        assert 0 <= r["cluster"] < 7
        assert r["dist"] == pytest.approx(min(distances), abs=1e-9)
        assert r["dist"] == pytest.approx(distances[r["cluster"]], abs=1e-9)
    measured = cluster.all_distances(space.rows, [(i, list(c)) for i, c in enumerate(centres)], "lsa")
    for r in measured.collect():
        assert r["distances"] == pytest.approx([np.linalg.norm(np.array(r["lsa"]) - c) for c in centres])
    top = cluster.cluster_top_terms(space.basis, cluster.model_centres(model, space.rows), 5).collect()
    assert len(top) == 35
    for k in range(7):
        weights = [r["weight"] for r in sorted((r for r in top if r["cluster"] == k), key=lambda r: r["rank"])]
        assert weights == sorted(weights, reverse=True)


def test_default_cluster_count(spark, sf_dir):
    rows = views.vectors(spark, sf_dir)
    assert cluster.fit_kmeans(rows, "vector", use_default_k=True).summary.k == 8


def test_topics(corpus):
    cfg = TopicConfig(k=6, min_df=2, max_features=60, max_iter=5)
    found = topics.fit_topics(corpus, cfg)
    mix = topics.topic_mix(found).collect()
    assert "150" not in {r["id_str"] for r in mix} and len(mix) == 150
    for r in mix:
        assert sum(r["mix"]) == pytest.approx(1.0)
        assert r["mix"][r["topic"]] == max(r["mix"])
    words = topics.topic_words(found, 4).collect()
    assert len(words) == 24
    assert {r["term"] for r in words} <= set(found.vocabulary)


def test_shares_of_a_post_are_those_of_plain_steps():
    """The extrapolated steps end where many plain ones do, also for empty and very long posts."""
    draw = np.random.default_rng(5)
    weights, prior = draw.gamma(0.3, 1.0, (4, 30)) + 0.01, np.array([0.1, 0.2, 0.3, 0.4])
    dense = draw.poisson(draw.choice([0.02, 0.5, 40.0], (60, 1)), (60, 30)).astype(float)
    dense[0] = 0
    likely = np.exp(topics._log_means(weights))
    plain = prior + dense.sum(axis=1, keepdims=True) / 4
    for _ in range(5000):
        part = np.exp(topics._log_means(plain))
        plain = prior + part * ((dense / (part @ likely + 1e-100)) @ likely.T)
    got = topics._post_shares(dense, likely, prior)
    assert (np.abs(got - plain).max(axis=1) <= 0.02 + 1e-4 * dense.sum(axis=1)).all()
    assert got[0] == pytest.approx(prior)


def test_topics_do_not_depend_on_how_posts_are_dealt(corpus):
    cfg = TopicConfig(k=6, min_df=2, max_features=60, max_iter=3)
    one, two = topics.fit_topics(corpus, cfg), topics.fit_topics(corpus.repartition(1), cfg)
    assert one.weights == pytest.approx(two.weights, rel=1e-9)
    assert one.prior == pytest.approx(two.prior, rel=1e-9)


@pytest.mark.parametrize("bound", [1_000_000, 3], ids=["small", "joined"])
def test_word_vectors(corpus, bound):
    cfg, found = WordVectorConfig(size=6, min_count=2, sample=1.0, negatives=1), LookupConfig(max_broadcast_rows=bound)
    vectors = embed.fit_word_vectors(corpus, cfg, found)
    known = {r["word"]: np.array(r["vector"]) for r in vectors.collect()}
    assert {len(v) for v in known.values()} == {6} and "zzz" not in known
    # words of one theme stand together, so they are near
    like = [known["t0w0"] @ known[f"t0w{i}"] for i in range(1, 12)]
    unlike = [known["t0w0"] @ known[f"t3w{i}"] for i in range(12)]
    assert min(like) > max(unlike)
    similar = embed.similar_words(vectors, ["t0w0", "nowhere"], 5).orderBy("rank").collect()
    assert [r["example"] for r in similar] == ["t0w0"] * 5
    assert similar[0]["word"] == "t0w0" and similar[0]["similarity"] == pytest.approx(1.0)
    falling = [r["similarity"] for r in similar]
    assert falling == sorted(falling, reverse=True)
    assert embed.similar_words(vectors, ["nowhere"]).count() == 0
    averaged = {r["id_str"]: r["vector"] for r in embed.document_vectors(vectors, corpus, found).collect()}
    for r in corpus.collect():
        mean = sum((known[w] for w in r["words"] if w in known), np.zeros(6)) / len(r["words"])
        assert averaged[r["id_str"]] == pytest.approx(mean.tolist(), abs=1e-9)


def test_window_pairs_equal_counting(spark):
    draw = random.Random(3)
    texts = [draw.choices("abcde", k=draw.randint(0, 25)) for _ in range(20)]
    want = {}
    for words in texts:
        for i, a in enumerate(words):
            for j, b in enumerate(words):
                if i != j and abs(i - j) <= 3:
                    want[a, b] = want.get((a, b), 0) + 1
    df = spark.createDataFrame([(w,) for w in texts], "words array<string>").repartition(3)
    assert {(r["a"], r["b"]): r["n"] for r in embed.window_pairs(df, 3).collect()} == want


def test_flat_maps(spark, sf_dir):
    flat = queries.map_2d(spark, sf_dir).collect()
    x = np.array([[r["x"], r["y"]] for r in flat])
    v = np.array([r["vector"] for r in views.vectors(spark, sf_dir).collect()])
    centred = v - v.mean(axis=0)
    _, s, _ = np.linalg.svd(centred, full_matrices=False)
    spread = np.linalg.norm(x - x.mean(axis=0), axis=0)
    assert spread == pytest.approx(s[:2], rel=1e-6)
    units = [np.linalg.norm(r["pca"]) for r in queries.pca_embed(spark, sf_dir).collect()]
    assert units == pytest.approx([1.0] * len(units))


@pytest.mark.parametrize("bound", [1_000_000, 3], ids=["small", "joined"])
def test_numbered_pairs_are_the_window_pairs_of_known_words(spark, monkeypatch, bound):
    """Words that are not numbered keep their place; pairs are cut at no text or run of words."""
    monkeypatch.setattr(embed, "PAIR_WORDS", 7)
    monkeypatch.setattr(embed, "HELD_PAIRS", 11)
    draw = random.Random(3)
    data = [(draw.choices("abcdefgh", k=draw.randint(0, 30)),) for _ in range(25)] + [(None,), (["a", None, "a"],)]
    df = spark.createDataFrame(data, "words array<string>")
    numbered = spark.createDataFrame([(w, i, 9) for i, w in enumerate("fbdace")], "term string, number long, count long")
    pairs = embed._numbered_pairs(df, numbered, 6, 3, LookupConfig(max_broadcast_rows=bound))
    got = {}
    for r in pairs.collect():
        a, b = "fbdace"[r["a"]], "fbdace"[r["b"]]
        got[a, b] = got[b, a] = r["n"] * (2 if a == b else 1)
    want = {(r["a"], r["b"]): r["n"] for r in embed.window_pairs(df, 3).collect()}
    assert got == {k: n for k, n in want.items() if set(k) <= set("fbdace")}
