"""Models that are saved and loaded again."""

from __future__ import annotations

import os

import numpy as np
import pytest

from storyrank.config import ClusterConfig, LookupConfig, LsaConfig, TfIdfConfig
from storyrank.operators import features, kmeans, lsa, topics
from storyrank.sources import models


def themes(spark, n=80):
    rng = np.random.default_rng(6)
    rows = [(str(i), [f"t{i % 4}w{w}" for w in rng.integers(0, 9, 10)] + [f"c{w}" for w in rng.integers(0, 5, 3)]) for i in range(n)]
    return spark.createDataFrame([*rows, ("none", ["zzz"])], "id_str string, words array<string>").repartition(3)


def rows_of(df, column):
    return {r["id_str"]: r[column] for r in df.collect()}


@pytest.mark.parametrize("cfg", [LsaConfig(components=5), LsaConfig(components=5, max_block_bytes=900)], ids=["shipped", "joined"])
def test_a_loaded_basis_gives_the_rows_of_the_fit(spark, tmp_path, cfg):
    words = themes(spark)
    terms = features.term_stats(words, 81, TfIdfConfig(min_df=2, max_df=0.9))
    found = lsa.fit_lsa(words, terms, cfg)
    path = str(tmp_path / "lsa")
    models.save_model(spark, path, {"terms": terms.select("term", "idf"), "basis": found.basis}, {"components": 5})
    saved = models.load_model(spark, path)
    bound = LookupConfig(max_broadcast_rows=4)
    again = lsa.project(words, saved.tables["terms"], saved.tables["basis"], cfg, bound)
    fitted, applied = rows_of(found.rows, "lsa"), rows_of(again, "lsa")
    assert saved.facts == {"components": 5} and fitted.keys() == applied.keys()
    for key in fitted:
        assert applied[key] == pytest.approx(fitted[key], abs=1e-9)
    # other posts, too
    other = spark.createDataFrame([("new", ["t1w1", "t1w2"]), ("blank", [])], "id_str string, words array<string>")
    new = rows_of(lsa.project(other, saved.tables["terms"], saved.tables["basis"], cfg, bound), "lsa")
    assert np.linalg.norm(new["new"]) == pytest.approx(1.0) and not any(new["blank"])


def test_loaded_centres_and_topics_apply_as_fitted(spark, tmp_path):
    rng = np.random.default_rng(3)
    points = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(rng.standard_normal((60, 3)))], "id_str string, v array<double>")
    found = kmeans.fit(points, "id_str", "v", ClusterConfig(k=4))
    models.save_centres(spark, str(tmp_path / "centres"), found)
    loaded = models.load_centres(spark, str(tmp_path / "centres"))
    assert (loaded.centres == found.centres).all() and (loaded.rounds, loaded.cost) == (found.rounds, found.cost)
    assert rows_of(kmeans.assign(loaded, points, "v"), "cluster") == rows_of(kmeans.assign(found, points, "v"), "cluster")

    words = themes(spark)
    table = spark.createDataFrame([(k, f"t{k}w{i}", 0.1) for k in range(4) for i in range(9)], "topic int, term string, weight double")
    models.save_model(spark, str(tmp_path / "topics"), {"topics": table})
    again = models.load_model(spark, str(tmp_path / "topics")).tables["topics"]
    assert rows_of(topics.fold_in(words, again), "mix") == rows_of(topics.fold_in(words, table), "mix")


def test_a_write_that_stops_halfway_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, path)
    assert models.save_model(spark, path, {"a": spark.range(3), "b": spark.range(4)}) == 1

    class Lost:
        @property
        def write(self):
            raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        models.save_model(spark, path, {"a": spark.range(9), "b": Lost()})
    assert os.path.exists(f"{path}/v2/a")
    saved = models.load_model(spark, path)
    assert saved.version == 1 and saved.tables["a"].count() == 3 and set(saved.tables) == {"a", "b"}
    assert models.save_model(spark, path, {"a": spark.range(5)}) == 3
    assert models.load_model(spark, path).tables["a"].count() == 5
    assert models.load_model(spark, path, version=1).tables["b"].count() == 4
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, path, version=2)
