"""Search, topics and epochs against plain versions."""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyrank.config import ClusterConfig, LookupConfig
from storyrank.operators import epochs, kmeans, nearest, rank, topics
from storyrank.operators.metrics import stored_with_counts
from storyrank.plans import steps


def all_pairs(rows, queries, k):
    """{(example, rank): (key, similarity)} by comparing all pairs."""
    def unit(v):
        if v is None or len(v) == 0 or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float) / max(abs(x) for x in v)
        return v / np.linalg.norm(v)

    out = {}
    units = [(key, unit(v)) for key, v in rows if key is not None]
    for example, q in ((key, unit(v)) for key, v in queries if key is not None):
        if q is None:
            continue
        found = [(-round(float(q @ v), 9), key) for key, v in units if v is not None and len(v) == len(q)]
        for rank, (value, key) in enumerate(sorted(found)[:k], 1):
            out[example, rank] = key, -value
    return out


def search(spark, rows, queries, k, kind="string", cfg=nearest.NearestConfig()):
    schema = f"word {kind}, vector array<double>"
    made = nearest.nearest(
        spark.createDataFrame(rows, schema).repartition(4), spark.createDataFrame(queries, schema), k, cfg=cfg
    )
    return {(r["example"], r["rank"]): (r["word"], pytest.approx(r["similarity"], abs=1e-9)) for r in made.collect()}


SMALL = nearest.NearestConfig(block_bytes=300, tile_cells=50)


@pytest.mark.parametrize("cfg", [nearest.NearestConfig(), SMALL], ids=["one block", "many blocks"])
def test_nearest_with_ties_nulls_and_zeros(spark, cfg):
    rng = np.random.default_rng(3)
    rows = [(f"w{i}", v.tolist()) for i, v in enumerate(rng.standard_normal((60, 4)))]
    rows += [(f"tie{i:02d}", [1.0, 2.0, 0.0, 0.0]) for i in range(30)] + [("scaled", [1e200, 2e200, 0.0, 0.0])]
    rows += [
        ("null", None), ("empty", []), ("zero", [0.0] * 4), ("hole", [1.0, None, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]),
        ("nan", [float("nan"), 0.0, 0.0, 1.0]), ("inf", [float("inf"), 0.0, 0.0, 1.0]),
        ("short", [1.0, 2.0]), ("short2", [2.0, 1.0]), ("ümlaut 日", [1.0, 2.0, 1e-12, 0.0]),
    ]
    assert search(spark, rows, rows, 7, cfg=cfg) == all_pairs(rows, rows, 7)


def test_nearest_of_other_rows_with_number_keys(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 8)))]
    queries = [(-i, v.tolist()) for i, v in enumerate(rng.standard_normal((40, 8)))]
    assert search(spark, rows, queries, 10, "long", SMALL) == all_pairs(rows, queries, 10)
    assert search(spark, rows[:3], queries[:2], 10, "long") == all_pairs(rows[:3], queries[:2], 10)


@pytest.mark.parametrize("rows, queries", [([], [("a", [1.0])]), ([("a", [1.0])], [])])
def test_nearest_of_nothing(spark, rows, queries):
    assert search(spark, rows, queries, 3) == {}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1_000, 1_001])
def test_epochs_are_permutations(spark, n):
    rows = spark.range(n).select(F.col("id").alias("seq"))
    placed = epochs.epoch_order(rows, ["seq"], [0, 1, 7]).collect()
    order = {e: [r["place"] for r in sorted(placed, key=lambda r: r["seq"]) if r["epoch"] == e] for e in (0, 1, 7)}
    for places in order.values():
        assert sorted(places) == list(range(n))
    if n >= 10:
        assert len({tuple(p) for p in order.values()}) == 3
    again = epochs.epoch_order(rows.repartition(3), ["seq"], [7]).collect()
    assert [r["place"] for r in sorted(again, key=lambda r: r["seq"])] == order[7]


def test_epochs_look_shuffled(spark):
    rows = spark.range(5_000).select(F.col("id").alias("seq"))
    placed = epochs.epoch_order(rows, ["seq"], [3], seed=9).orderBy("seq").collect()
    x = np.array([r["place"] for r in placed])
    assert abs(np.corrcoef(x, np.arange(5_000))[0, 1]) < 0.05
    assert abs(np.corrcoef(x[1:], x[:-1])[0, 1]) < 0.05
    read = [r["seq"] for r in epochs.in_epoch(rows, 3, ["seq"], seed=9).collect()]
    assert read == np.argsort(x).tolist()


def test_no_rows_have_no_order(spark):
    assert epochs.epoch_order(spark.range(0).withColumnRenamed("id", "seq"), ["seq"], [0]).count() == 0


def plain_fold(words, table, steps):
    names = sorted({t for t, _, _ in table})
    weight = {(t, w): v for t, w, v in table}
    share = {t: 1 / len(names) for t in names}
    known = [w for w in words or [] if any(weight.get((t, w), 0) > 0 for t in names)]
    if not known:
        return None
    for _ in range(steps):
        sums = dict.fromkeys(names, 0.0)
        for w in known:
            part = {t: share[t] * weight.get((t, w), 0) for t in names}
            for t in names:
                sums[t] += part[t] / sum(part.values())
        share = {t: s / sum(sums.values()) for t, s in sums.items()}
    return [share[t] for t in names]


@pytest.mark.parametrize("cfg", [LookupConfig(), LookupConfig(max_broadcast_rows=2)], ids=["in place", "joined"])
def test_fold_in_by_hand(spark, cfg):
    table = [("b", "x", 0.7), ("b", "y", 0.3), ("a", "y", 0.5), ("a", "z", 0.5), ("c", "x", 0.0), ("c", "q", 1.0)]
    posts = [("1", ["x", "y", "y", "zzz"]), ("2", []), ("3", None), ("4", ["zzz"]), ("5", ["q"]), ("6", ["y"] * 50 + ["x"])]
    topic_terms = spark.createDataFrame(table, "topic string, term string, weight double")
    words = spark.createDataFrame(posts, "id_str string, words array<string>").repartition(2)
    for steps in (0, 1, 6):
        got = {r["id_str"]: r for r in topics.fold_in(words, topic_terms, steps, cfg).collect()}
        for i, w in posts:
            want = plain_fold(w, table, steps)
            assert (want is None) == (i not in got)
            if want is not None:
                assert got[i]["mix"] == pytest.approx(want, abs=1e-12)
                assert got[i]["topic"] == ["a", "b", "c"][int(np.argmax(np.round(want, 9)))]


def test_fold_in_without_topics(spark):
    words = spark.createDataFrame([("1", ["x"])], "id_str string, words array<string>")
    none = spark.createDataFrame([], "topic int, term string, weight double")
    assert topics.fold_in(words, none).collect() == [] and topics.heaviest_words(none).collect() == []


def test_heaviest_words_break_ties_by_word(spark):
    table = [(1, "b", 0.2), (1, "a", 0.2), (1, "c", 0.5), (2, "a", 1.0)]
    found = topics.heaviest_words(spark.createDataFrame(table, "topic int, term string, weight double"), 2)
    assert sorted(map(tuple, found.collect())) == [(1, 1, "c", 0.5), (1, 2, "a", 0.2), (2, 1, "a", 1.0)]


def hashed(seed, number, key):
    return (int(hashlib.md5(f"{seed}:{number}:{key}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def plain_kmeans(rows, k, rounds, seed):
    x = np.array([v for _, v in rows])
    chosen = []
    for number in range(k):
        far = np.min([((x - c) ** 2).sum(axis=1) for c in chosen], axis=0) if chosen else np.ones(len(x))
        race = [(-np.log(hashed(seed, number, key)) / d, key, i) for i, (key, _) in enumerate(rows) if (d := far[i]) > 0]
        if not race:
            break
        chosen.append(x[min(race)[2]])
    centres = np.array(chosen)
    for _ in range(rounds):
        near = np.argmin([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres = np.array([x[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
    return np.argmin([((x - c) ** 2).sum(axis=1) for c in centres], axis=0), centres


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_kmeans_replays_plain_lloyd(spark, rounds):
    rng = np.random.default_rng(2)
    rows = [(f"p{i}", (rng.standard_normal(5) + 4 * (i % 6 == np.arange(5))).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    labels, centres = plain_kmeans(rows, 6, rounds, 11)
    for parts in (1, 7):
        given = df.repartition(parts)
        seeds = kmeans.draw_seeds(given, "id", "v", 6, 11)
        found = kmeans.lloyd(given, "v", seeds, rounds)
        assert found.centres == pytest.approx(centres, abs=1e-9)
        got = {r["id"]: r for r in kmeans.assign(found, given, "v").collect()}
        for (key, v), label in zip(rows, labels):
            assert got[key]["cluster"] == label
            assert got[key]["dist"] == pytest.approx(np.linalg.norm(np.array(v) - centres[label]), abs=1e-9)


def test_kmeans_with_few_different_rows(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = kmeans.fit(df, "id", "v", ClusterConfig(k=8))
    assert sorted(found.centres[:, 0].tolist()) == [0.0, 1.0, 2.0] and found.cost == 0.0
    assert found.rounds == 1
    none = kmeans.fit(df.limit(0), "id", "v", ClusterConfig(k=8))
    assert len(none.centres) == 0


def test_misses_are_counted_on_the_pass_that_joins(spark):
    chosen = spark.createDataFrame([("1", 5), ("2", 6), ("9", 7)], "id_str string, extra int")
    table = spark.createDataFrame([("1", "a", "t", 1), ("2", "b", "t", 2)], "id_str string, tweet string, ctime string, rt_cnt int")
    posts, misses = rank.fields_by_id(chosen, table)
    assert misses == 1
    assert sorted((r["id_str"], r["extra"], r["tweet"]) for r in posts.collect()) == [("1", 5, "a"), ("2", 6, "b")]


def test_counts_come_with_the_write(spark, tmp_path):
    path = str(tmp_path / "numbers")
    spark.range(100).write.parquet(path)
    before = spark.read.parquet(path)
    table, counts = stored_with_counts(before, "n", {"all": F.count("*"), "even": F.count_if(F.col("id") % 2 == 0)})
    assert counts == {"all": 100, "even": 50} and table.count() == 100
    plan = before.observe("x", F.count("*").alias("all"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert stored_with_counts(before.limit(0), "n", {"all": F.count("*"), "sum": F.sum("id")})[1] == {"all": 0, "sum": 0}


@pytest.mark.parametrize("per_task", [1, 2, 100])
def test_landed_pages_are_whole_and_in_order(spark, tmp_path, per_task):
    path = str(tmp_path / "pages")
    lines = spark.range(95).select(F.col("id").alias("at"), (F.col("id") * 37 % 95).alias("seq")).withColumn("value", F.format_string("%03d", "seq"))
    steps.land_pages(lines.repartition(5), 95, path, per_page=10, pages_per_task=per_task)
    files = sorted(os.listdir(path))
    pages = [open(f"{path}/{f}").read().split() for f in files if f.endswith(".txt")]
    assert pages == [[f"{i:03d}" for i in range(n, min(n + 10, 95))] for n in range(0, 95, 10)]
    tasks = {f.split("-")[1] for f in files if f.startswith("part-")}
    assert len(tasks) == -(-10 // per_task)


def test_landed_pages_of_no_lines(spark, tmp_path):
    path = str(tmp_path / "pages")
    steps.land_pages(spark.createDataFrame([], "at long, seq long, value string"), 0, path, per_page=10)
    assert spark.read.text(path).count() == 0
