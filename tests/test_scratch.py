"""What jobs leave in the scratch folder, and the packed tables they keep there."""

from __future__ import annotations

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from storyrank.config import LookupConfig, LsaConfig, PhraseConfig, TfIdfConfig, WordVectorConfig
from storyrank.operators import embed, features, lsa, pairs, phrases
from storyrank.sources.scratch import discard, scratch_root, stored


def names(spark) -> set[str]:
    root = scratch_root(spark)
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def left(spark, before: set[str]) -> list[str]:
    return sorted({name.rsplit("-", 1)[0] for name in names(spark) - before})


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(5)
    rows = [(str(i), draw.choices([f"w{k}" for k in range(60)], k=draw.randint(0, 30))) for i in range(120)]
    return spark.createDataFrame(rows, "id_str string, words array<string>").repartition(4).cache()


def test_a_discarded_table_is_gone(spark):
    before = names(spark)
    table = stored(spark.range(5), "gone")
    assert table.count() == 5 and left(spark, before) == ["gone"]
    discard(table, spark.range(3))
    assert left(spark, before) == []


def test_whole_numbers_come_back():
    for top in (0, 1, 255, 256, 70_000, 1 << 33, 1 << 50):
        values = np.array([0, top, top // 2, 1, top], np.int64)
        packed = pairs.pack_numbers(values)
        assert pairs.unpack_numbers(pa.py_buffer(packed), 5).tolist() == values.tolist()


def test_word_vectors_leave_no_pairs_behind(spark, texts, monkeypatch):
    """F1 F2 F3: neither pairs, cells nor rounds stay, and no cell is dealt to a lane."""
    monkeypatch.setattr(lsa, "_tiles", None)
    before = names(spark)
    vectors = embed.fit_word_vectors(texts, WordVectorConfig(size=6, min_count=2, sample=1.0, negatives=1))
    assert vectors.count() == 60
    stays = left(spark, before)
    assert "word-vectors" in stays
    assert not {"window-pairs", "pair-weights", "word-matrix", "lsa-matrix", "lsa-pieces"} & set(stays)


def test_a_square_matrix_is_multiplied_whole(spark, texts, tmp_path, monkeypatch):
    """Cells of a row stay together however few go into a packed row."""
    monkeypatch.setattr(pairs, "PACKED_KEYS", 16)
    monkeypatch.setattr(pairs, "WEIGHED_CELLS", 7)
    monkeypatch.setattr(pairs, "FACTOR_ROWS", 9)
    numbered = embed._numbered_words(texts, 2)
    n = numbered.count()
    cfg = WordVectorConfig(window=3, min_count=2, sample=1.0, negatives=1)
    packed, made, cells = embed._packed_information(texts, numbered, n, cfg, LookupConfig())
    dense = np.zeros((n, n))
    for r in pairs.pair_rows(packed, n).collect():
        if made.positive(*(np.array([r[c]]) for c in "abn"))[0]:
            dense[r["a"], r["b"]] = dense[r["b"], r["a"]] = made.lift(*(np.array([r[c]]) for c in "abn"))[0]
    matrix = stored(pairs.square(packed, n, cells, made.positive), "word-matrix")
    q, turn = np.random.default_rng(1).normal(size=(n, 4)), np.diag([1.0, 2.0, 3.0, 4.0])
    source = pairs.reserve(f"{tmp_path}/q", n, 4)
    pairs.write_rows(source, 0, q)
    target = pairs.multiply(matrix, n, made.lift, source, turn, f"{tmp_path}/out/y")
    assert pairs.mapped(target, 4) == pytest.approx(dense @ q @ turn)


def test_a_mapped_fit_leaves_what_its_rows_need(spark, texts):
    """F4 F5 F7 F8 F10 F11 F12: files and pieces of a round go when the next one has read them."""
    terms = features.term_stats(texts, 120, TfIdfConfig(min_df=2, max_df=0.9)).cache()
    before = names(spark)
    found = lsa.fit_lsa(texts, terms, LsaConfig(components=6, oversample=6, rounds=3, max_block_bytes=20 * 12 * 8))
    folders = names(spark) - before
    assert len([f for f in folders if f.startswith("lsa-pieces")]) == 1
    assert not [f for f in folders if f.startswith(("lsa-matrix", "lsa-turned", "lsa-mapped"))]
    assert found.rows.count() == 120 and found.basis.count() == terms.count()


def test_counts_stand_for_weights(spark, texts):
    terms = features.term_stats(texts, 120, TfIdfConfig(min_df=2, max_df=0.9)).orderBy("term").toArrow()
    idf = terms["idf"].to_numpy()
    weights = {r["id_str"]: r for r in features.tfidf_rows(texts, terms).collect()}
    for r in features.count_rows(texts, terms).collect():
        want = weights[r["id_str"]]
        assert r["idx"] == want["idx"]
        assert [tf * idf[t] / r["norm"] for t, tf in zip(r["idx"], r["val"])] == want["val"]


@pytest.mark.parametrize("least", [0, 1, 2, 3])
def test_phrases_counted_as_numbers_are_those_counted_as_words(spark, least, monkeypatch):
    """words that occur once have no number, their pairs count all the same."""
    draw = random.Random(7)
    rows = [(" ".join(draw.choices("abcdefg", k=draw.randint(0, 9)) + [f"x{i}"] * (i % 3 == 0) + ["p", "q"] * (i % 5 == 0)),) for i in range(60)]
    corpus = spark.createDataFrame([*rows, ("",), (None,), ("solo",)], "clean string").repartition(3)
    cfg = PhraseConfig(min_count=least, threshold=0.5)
    worded = {tuple(r) for r in phrases.phrase_scores(corpus, cfg, LookupConfig(max_broadcast_rows=1)).collect()}
    monkeypatch.setattr(phrases, "pair_counts", None)
    assert {tuple(r) for r in phrases.phrase_scores(corpus, cfg).collect()} == worded and worded


def test_vectors_of_a_repeated_word_add_up(spark):
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0, 0.0]), ("b", [0.0, 4.0]), (None, [9.0, 9.0])], "word string, vector array<double>")
    docs = spark.createDataFrame([("1", ["a", "b", "x", None]), ("2", []), ("3", None), ("3", ["b"])], "id_str string, words array<string>")
    got = sorted((r["id_str"], r["vector"]) for r in embed.document_vectors(vectors, docs).collect())
    assert got == [("1", [0.5, 1.5]), ("2", [0.0, 0.0]), ("3", [0.0, 0.0]), ("3", [0.0, 4.0])]
    assert got == sorted((r["id_str"], r["vector"]) for r in embed.document_vectors(vectors, docs, LookupConfig(max_broadcast_rows=0)).collect())
