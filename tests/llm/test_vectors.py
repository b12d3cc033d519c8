from __future__ import annotations

import random

import numpy as np
import pytest

from storyrank.llm import pstable_neighbours as near
from tests.llm.helpers import groups

SPLIT = near.PStableConfig(bucket_rows=5, pair_rows=3, hold_rows=40)


def plain(rows, threshold=0.95):
    """{number: (links, component of ids)} by comparing all pairs."""
    vectors = [near._valid(v) for _, v in rows]
    links = []
    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if a is None or b is None or len(a) != len(b):
                continue
            if near._unit(a[None])[0] @ near._unit(b[None])[0] >= threshold:
                links.append((i, j))
    component = groups(links, range(len(rows)))
    least = {}
    for i, root in component.items():
        if rows[i][0] is not None:
            least[root] = min(least.get(root, rows[i][0]), rows[i][0])
    count = np.bincount(np.array(links, int).ravel(), minlength=len(rows))
    return sorted((rows[i][0] is not None, rows[i][0] or 0, int(count[i]), least.get(component[i])) for i in range(len(rows)))


def found(df, cfg=near.PStableConfig()):
    rows = near.embedding_links(df, cfg=cfg).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    return sorted((r["vec_id"] is not None, r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in rows)


def clusters(rng, dims=16):
    rows = []
    for size in (1, 1, 2, 5, 40, 90):
        centre = rng.standard_normal(dims)
        for _ in range(size):
            rows.append((len(rows), (centre + 0.12 * rng.standard_normal(dims)).astype(float).tolist()))
    return rows


@pytest.mark.parametrize("cfg", [near.PStableConfig(miss=1e-6), near.PStableConfig(miss=1e-6, bucket_rows=5, pair_rows=3, hold_rows=40)])
def test_links_equal_brute_force(spark, cfg):
    rows = clusters(np.random.default_rng(8))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert found(df, cfg) == plain(rows)


@pytest.mark.parametrize("cfg", [near.PStableConfig(), SPLIT])
def test_hard_vectors(spark, cfg):
    one, big = [1.0, 2.0, 2.0], [1e300, 2e300, 2e300]
    rows = [
        (3, one), (2, one), (2, one), (7, big), (1, None), (4, []), (5, [0.0, 0.0, 0.0]),
        (6, [1.0, None, 2.0]), (8, [float("nan"), 1.0, 0.0]), (9, [float("inf"), 1.0, 0.0]),
        (10, [1.0, 2.0]), (11, [-1.0, -2.0, -2.0]), (None, one), (12, [1e-300, 2e-300, 2e-300]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    from pyspark.sql import functions as F

    df = df.withColumns({c: F.lit("own") for c in ("uid", "bucket", "label", "n_links")})
    assert found(df, cfg) == plain(rows)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "vec_id long, embedding array<float>")) == []


def test_keys_do_not_depend_on_the_rows_around():
    rng = np.random.default_rng(1)
    rows = near._unit(rng.standard_normal((50, 64)))
    hashes = near.Hashes(64, 9, 12, near.PStableConfig())
    assert (hashes.keys(rows)[17] == hashes.keys(rows[17:18])[0]).all()
    assert (hashes.keys(rows[::-1])[::-1] == hashes.keys(rows)).all()


def test_recall_at_the_threshold():
    """Pairs exactly at the threshold meet as often as the number of tables is chosen for."""
    cfg = near.PStableConfig()
    width, tables = cfg.shape(50_000)
    rng = np.random.default_rng(2)
    a = near._unit(rng.standard_normal((2000, 64)))
    side = rng.standard_normal((2000, 64))
    side = near._unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * side
    hashes = near.Hashes(64, width, tables, cfg)
    met = (hashes.keys(a) == hashes.keys(b)).any(axis=1)
    assert met.mean() > 1 - 2 * cfg.miss


def test_given_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    copies = random.Random(3).sample(rows, 40)
    rows += [(10_000 + i, [x * 1.5 for x in v]) for i, v in copies]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert found(df) == plain(rows)
