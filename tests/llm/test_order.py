from __future__ import annotations

import bisect
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyrank.llm import hilbert_shards as hilbert
from storyrank.llm import pfair_mix as mix
from storyrank.llm import queries
from storyrank.llm.common import component_labels
from storyrank.operators.prefix import running_totals
from storyrank.sources.scratch import scratch_path
from tests.llm.helpers import DOCUMENTS, ROWS, frame, groups


@pytest.mark.parametrize("n, bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_goes_one_step_at_a_time(spark, n, bits):
    points = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(points, ", ".join(f"c{i} int" for i in range(n)))
    index = hilbert.hilbert_index([F.col(f"c{i}") for i in range(n)], bits)
    rows = sorted(df.select(index.alias("h"), "*").collect())
    assert [r["h"] for r in rows] == list(range(1 << n * bits))
    assert all(sum(abs(x - y) for x, y in zip(a[1:], b[1:])) == 1 for a, b in zip(rows, rows[1:]))


def test_shards_of_documents(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.op3_hilbert_shards(spark, sf_dir).collect()
    sizes = Counter(r["shard"] for r in found)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())

    def cells(column):
        values = sorted(d[column] for d in docs.values())
        return {i: bisect.bisect_left(values, d[column]) * 16 // len(docs) for i, d in docs.items()}

    grid = [cells(c) for c in ("source", "lang", "n_chars", "doc_id")]
    points = spark.createDataFrame([(i, *[g[i] for g in grid]) for i in docs], "doc_id long, a int, b int, c int, d int")
    index = hilbert.hilbert_index([F.col(c) for c in "abcd"], 4)
    expected = {r["doc_id"]: r["h"] for r in points.select("doc_id", index.alias("h")).collect()}
    assert all(expected[r["doc_id"]] == r["hilbert"] for r in found)
    order = sorted(found, key=lambda r: (r["hilbert"], r["text_crc32"], r["doc_id"]))
    places = [(r["shard"], r["slot"]) for r in order]
    assert places == sorted(places)


def test_shards_of_hard_rows(spark):
    cfg = hilbert.HilbertConfig(bits=3, shards=4)
    placed = hilbert.hilbert_shards(frame(spark), ["source", "n_chars", "doc_id"], ["doc_id"], cfg)
    sizes = Counter(r["shard"] for r in placed.collect())
    assert sum(sizes.values()) == len(ROWS) and max(sizes.values()) - min(sizes.values()) <= 1
    empty = spark.createDataFrame([], DOCUMENTS)
    assert hilbert.hilbert_shards(empty, ["source"], ["doc_id"], cfg).count() == 0
    path = scratch_path(spark, "shards")
    hilbert.write_shards(placed, path, 4)
    assert spark.read.parquet(path).count() == len(ROWS)


def plain_schedule(shares):
    """Earliest deadline first, slot by slot; the deviation is checked on the way."""
    period, done, slots = sum(shares.values()), dict.fromkeys(shares, 0), {}
    names = sorted(shares, key=lambda s: (s is not None, s or ""))
    for slot in range(period):
        ready = [
            (-(-(done[s] + 1) * period // shares[s]), i, s) for i, s in enumerate(names)
            if done[s] < shares[s] and done[s] * period // shares[s] <= slot
        ]
        deadline, _, s = min(ready)
        assert slot < deadline
        slots[s, done[s]] = slot
        done[s] += 1
        assert all(abs(done[x] - (slot + 1) * shares[x] / period) < 1 for x in shares)
    return slots, period


def plain_mix(rows, cfg, weights=None):
    held = defaultdict(list)
    for doc_id, text, _, source, _ in rows:
        held[source].append((doc_id is not None, doc_id or 0, len((text or "").encode()) + 1))
    weights = weights or {s: max(round(math.sqrt(sum(x[2] for x in v))), 1) for s, v in held.items()}
    total = sum(weights.values())
    shares = {s: max((2 * cfg.period * w + total) // (2 * total), 1) for s, w in weights.items()}
    slots, period = plain_schedule(shares)
    out = []
    for source, docs in held.items():
        before = 0
        for _, doc_id, size in sorted(docs):
            block = before // cfg.block_bytes
            out.append((block // shares[source] * period + slots[source, block % shares[source]], before, doc_id))
            before += size
    return [x[2] for x in sorted(out)]


def test_mix_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in docs.collect()]
    for cfg in (mix.MixConfig(), mix.MixConfig(period=31, block_bytes=3000)):
        found = mix.mix_sources(docs, cfg=cfg).orderBy("position").collect()
        assert [r["position"] for r in found] == list(range(len(rows)))
        assert [r["doc_id"] for r in found] == plain_mix(rows, cfg)
    mixed = mix.mixed_rows(docs, cfg=cfg)
    assert mixed.columns == docs.columns
    assert [r["doc_id"] for r in mixed.collect()] == plain_mix(rows, cfg)


def test_given_weights_and_sources_without_rows(spark):
    rows = [(i, "x" * 9, "en", "a" if i % 3 else "b", 9) for i in range(60)]
    weights = spark.createDataFrame([("a", 1), ("b", 3), ("gone", 2)], "source string, weight long")
    cfg = mix.MixConfig(period=12, block_bytes=10)
    found = mix.mix_sources(spark.createDataFrame(rows, DOCUMENTS), weights, cfg=cfg).orderBy("position").collect()
    assert [r["doc_id"] for r in found] == plain_mix(rows, cfg, {"a": 1, "b": 3, "gone": 2})
    # while both last, b runs three times as often as a
    assert Counter(r["source"] for r in found[:24]) == {"b": 18, "a": 6}


@pytest.mark.parametrize(
    "weights",
    [[577] + [187] * 19, [999_000] + [1_000] * 399, [1], [3, 5, 7], [10**15, 10**15, 3 * 10**15], [4_000, 1]],
)
def test_no_source_is_a_block_from_its_given_weight(spark, weights):
    given = spark.createDataFrame([(f"s{i:03d}", w) for i, w in enumerate(weights)], "source string, weight long")
    slots = sorted(mix.period_schedule(mix.exact_shares(given)).collect(), key=lambda r: r["slot"])
    total = sum(weights)
    assert [r["slot"] for r in slots] == list(range(len(slots)))
    done = np.zeros(len(weights), np.int64)
    share = np.array(weights, object)
    for at, r in enumerate(slots, 1):
        done[int(r["source"][1:])] += 1
        # exact: |done - at w / W| < 1, in whole numbers
        assert all(abs(int(d) * total - at * w) < total for d, w in zip(done, share))
    # after one period every source stands at its share, so nothing drifts in the next
    assert all(int(d) * total == len(slots) * w for d, w in zip(done, share))


def test_weights_of_a_long_period_are_rounded(spark):
    weights = [1_000_003, 999_983, 7]
    given = spark.createDataFrame([(f"s{i}", w) for i, w in enumerate(weights)], "source string, weight long")
    shares = mix.exact_shares(given).first()["shares"]
    assert shares == [round(4_096 * w / sum(weights)) or 1 for w in weights]
    assert mix.exact_shares(given.limit(0)).first()["shares"] == []


def test_mix_of_given_weights_as_they_are(spark):
    rows = [(i, "x" * 9, "en", "a" if i < 700 else f"b{i % 30}", 9) for i in range(1_000)]
    pairs = [("a", 700)] + [(f"b{i}", 10) for i in range(30)]
    weights = spark.createDataFrame(pairs, "source string, weight long")
    found = mix.mix_sources(spark.createDataFrame(rows, DOCUMENTS), weights, cfg=mix.MixConfig(block_bytes=10))
    seen = Counter()
    for at, r in enumerate(found.orderBy("position").collect(), 1):
        seen[r["source"]] += 1
        assert abs(seen["a"] - 0.7 * at) < 1


def test_mix_of_hard_rows(spark):
    found = mix.mix_sources(frame(spark)).collect()
    assert sorted(r["position"] for r in found) == list(range(len(ROWS)))
    kept = mix.mixed_rows(frame(spark)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter((r[0], r[1]) for r in ROWS)
    assert all(r["uid"] == "own uid" for r in kept)
    assert mix.mix_sources(spark.createDataFrame([], DOCUMENTS)).count() == 0
    assert mix.mixed_rows(spark.createDataFrame([], DOCUMENTS)).count() == 0


def test_running_totals(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i long, n long").repartition(5)
    sums = defaultdict(int)
    expected = {}
    for g, i, n in rows:
        expected[i] = sums[g]
        sums[g] += n
    assert {r["i"]: r["n_before"] for r in running_totals(df, ["i"], ["n"], "g").collect()} == expected
    total = {r["i"]: r["n_before"] for r in running_totals(df, ["i"], ["n"]).collect()}
    assert [total[i] for i in range(500)] == [sum(r[2] for r in rows[:i]) for i in range(500)]


def test_components(spark):
    rng = random.Random(6)
    nodes = list(range(-200, 200))
    links = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(150)]
    links += [(i, i + 1) for i in range(100, 160)] + [(5, 5)]
    found = component_labels(spark.createDataFrame(links, "a long, b long")).collect()
    expected = groups(links, nodes)
    assert len(found) == len({r["node"] for r in found})
    got = {r["node"]: r["component"] for r in found}
    assert all(got.get(n, n) == expected[n] for n in nodes)
    assert component_labels(spark.createDataFrame([], "a long, b long")).count() == 0
