from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyrank.llm import queries
from storyrank.llm import spectral_whitening as white


def plain(rows, kept=32):
    """{vec_id: (n, deviation, whitened up to signs)}, shares: by a dense eigensolver."""
    x = np.array([[int(np.floor(64 * float(c))) + white.SHIFT for c in v] for _, v in rows])
    n, sums = len(x), [sum(map(int, c)) for c in x.T]
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    y = (x - white.SHIFT).astype(float)
    y -= y.mean(axis=0)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(kept, x.shape[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        z = y @ vectors[:, :kept] / np.sqrt(values[:kept])
    return n, deviation, z, values[:kept] / max(values.sum(), 1e-300)


def vectors_frame(spark, rows, parts=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    return df.withColumns({c: F.lit("own") for c in ("n", "whitened", "row", "slot", "payload", "m")})


def drawn(rng, n, d):
    mix = rng.standard_normal((d, d)) * np.linspace(0.1, 2, d)
    return [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((n, d)) @ mix)]


@pytest.mark.parametrize("n, d, parts", [(300, 12, 5), (300, 40, 1), (900, 64, 23)])
def test_whitening_equals_a_dense_solver(spark, n, d, parts):
    rows = drawn(np.random.default_rng(n + d), n, d)
    found = white.whiten(vectors_frame(spark, rows, parts), cfg=white.WhitenConfig(fan=3)).collect()
    count, deviation, z, shares = plain(rows)
    assert len(found) == n and {r["n"] for r in found} == {count}
    assert {r["row"]["vec_id"]: r["deviation"] for r in found} == dict(enumerate(deviation))
    got = np.array([r["whitened"] for r in sorted(found, key=lambda r: r["row"]["vec_id"])])
    assert found[0]["explained"] == pytest.approx(shares.tolist(), rel=1e-9)
    signs = np.sign((got * z).sum(axis=0))
    assert np.abs(got - z * signs).max() < 1e-7
    assert found[0]["identity_error"] < 1e-9


def test_updates_one_by_one_and_in_blocks_agree():
    rng = np.random.default_rng(4)
    x = np.floor(64 * rng.standard_normal((200, 16)) @ rng.standard_normal((16, 16))).astype(np.int64) + white.SHIFT
    x = np.concatenate([x, x[:50], np.repeat(x[:1], 30, axis=0)])
    single, blocks, merged = (white.Spectrum(16) for _ in range(3))
    for row in x:
        single.add(row[None])
    for begin in range(0, len(x), 70):
        blocks.add(x[begin : begin + 70])
        part = white.Spectrum(16)
        part.add(x[begin : begin + 70])
        merged.combine(part)
    y = (x - white.SHIFT).astype(float)
    y -= y.mean(axis=0)
    scatter = y.T @ y
    for s in (single, blocks, merged):
        assert s.n == len(x) and s.sums == [int(v) for v in x.sum(axis=0)]
        assert np.abs((s.vectors * s.values) @ s.vectors.T - scatter).max() < 1e-11 * scatter.max()
        assert np.abs(s.vectors.T @ s.vectors - np.eye(16)).max() < 1e-12


@pytest.mark.parametrize("case", ["equal", "few", "flat", "tiny", "spread"])
def test_secular_updates_with_deflation(case):
    rng = np.random.default_rng(7)
    d = 24
    rows = {
        "equal": np.repeat(np.eye(d), 3, axis=0),
        "few": rng.standard_normal((5, d)),
        "flat": rng.standard_normal((60, d)) * (np.arange(d) < 6),
        "tiny": rng.standard_normal((60, d)) * 1e-9,
        "spread": rng.standard_normal((60, d)) * 10.0 ** np.linspace(-8, 4, d),
    }[case]
    values, vectors = np.zeros(d), np.eye(d)
    for u in rows:
        values, vectors = white.rank_one(values, vectors, u)
    want = rows.T @ rows
    top = np.linalg.eigvalsh(want)[-1]
    assert np.abs(values - np.linalg.eigvalsh(want)).max() < 1e-12 * top
    assert np.abs((vectors * values) @ vectors.T - want).max() < 1e-12 * top
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-11


def test_hard_vectors(spark):
    good = drawn(np.random.default_rng(9), 40, 3)
    bad = [
        (100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 0.0]),
        (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0]),
    ]
    again = [(3, good[3][1]), (None, good[5][1]), (None, good[5][1])]
    found = white.whiten(vectors_frame(spark, good + bad + again)).collect()
    _, deviation, _, shares = plain(good + again)
    ids = [i for i, _ in good + again]
    order = lambda p: (p[0] is not None, p[0] or 0, p[1])
    assert sorted(((r["row"]["vec_id"], r["deviation"]) for r in found), key=order) == sorted(zip(ids, deviation), key=order)
    assert found[0]["explained"] == pytest.approx(shares.tolist(), rel=1e-9)
    assert found[0]["row"]["n"] == "own" and found[0]["n"] == 43


def test_rows_without_spread(spark):
    """One row, equal rows, rows on a line: components without variance are 0."""
    for rows in ([(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)]):
        for r in white.whiten(vectors_frame(spark, rows)).collect():
            assert r["whitened"] == [0.0, 0.0] and r["deviation"] == 0
            assert r["explained"] == [0.0, 0.0] and r["identity_error"] == 0.0
    line = white.whiten(vectors_frame(spark, [(i, [float(i), float(2 * i)]) for i in range(9)])).collect()
    assert {r["whitened"][1] for r in line} == {0.0}
    assert np.std([r["whitened"][0] for r in line]) == pytest.approx(1.0)


def test_deviation_past_a_long_is_null():
    x = np.array([[2**52, 0], [-(2**52), 0], [5, 0]])
    assert white._deviations(x, 3, np.array([5, 0], object)) == [None, None, 100]
    assert white.exact_sums(np.full((4096, 1), 2**52)) == [2**64]


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert white.whiten(df).collect() == []
    assert white.whiten(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect() == []


def test_query_equals_a_dense_solver(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    _, deviation, z, shares = plain(rows)
    found = queries.QUERIES["op13_spectral_whitening"](spark, sf_dir)
    assert dict(found.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
        "whitened": "double", "explained": "double", "identity_error": "double",
    }
    table = {(r["vec_id"], r["component"]): r for r in found.collect()}
    assert len(table) == 32 * len(rows)
    got = np.array([[table[i, c + 1]["whitened"] for c in range(32)] for i, _ in rows])
    assert np.abs(np.abs(got) - np.abs(z)).max() < 1e-6
    assert [table[i, 1]["deviation"] for i, _ in rows] == deviation
    assert [table[rows[0][0], c + 1]["explained"] for c in range(32)] == pytest.approx(shares.tolist(), rel=1e-9)
    assert table[rows[0][0], 1]["identity_error"] < 1e-9
