from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from storyrank.llm import grace_dedup as grace
from storyrank.llm import simhash_gray as gray
from tests.llm.helpers import DOCUMENTS, ROWS, ascii_lower, copies, frame, groups, simhash

SMALL = grace.GraceConfig(fold_bytes=200, table_bytes=300, out_rows=3)


@pytest.mark.parametrize("cfg", [grace.GraceConfig(), SMALL])
def test_classes_of_hard_rows(spark, cfg):
    found = grace.duplicate_classes(frame(spark), cfg=cfg).collect()
    expected = copies([(r[0], r[1]) for r in ROWS])
    assert len(found) == len(ROWS)
    by_sha = {e[2]: e for e in expected.values()}
    for row in found:
        keep_id, size, _ = by_sha[row["text_sha256"]]
        assert (row["keep_id"], row["group_size"]) == (keep_id, size)
    # one row of each class stays, also where rows are repeated
    kept = Counter(r["text_sha256"] for r in found if r["kept"])
    assert set(kept) == set(by_sha) and set(kept.values()) == {1}
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


@pytest.mark.parametrize("cfg", [grace.GraceConfig(), SMALL])
def test_kept_rows_are_whole_rows(spark, cfg):
    docs = frame(spark)
    kept = grace.drop_duplicates(docs, cfg=cfg)
    assert kept.schema.names == docs.schema.names
    rows = kept.collect()
    expected = copies([(r[0], r[1]) for r in ROWS])
    assert sorted(ascii_lower(r["text"]) for r in rows) == sorted(expected)
    assert {(r["doc_id"], r["text"]) for r in rows} <= {(r[0], r[1]) for r in ROWS}
    assert all(r["uid"] == "own uid" for r in rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert grace.duplicate_classes(empty).count() == 0
    assert grace.drop_duplicates(empty).count() == 0
    assert gray.simhash_components(empty).count() == 0
    assert gray.drop_near_duplicates(empty).count() == 0


def test_a_hot_text_is_folded_before_it_travels(spark):
    rows = [(i, "Same text" if i % 3 else f"text {i}", "en", "a", 9) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(4)
    folded = grace._folded(docs, "text", "doc_id", grace.GraceConfig(), members=False)
    assert folded.count() <= 1000 + 4
    assert {r["group_size"] for r in grace.duplicate_classes(docs).collect()} == {1, 2000}


def test_table_compares_content_and_not_hashes():
    table = grace.OpenTable()
    numbers = [table.place(7, f"text {i % 50}".encode())[0] for i in range(200)]
    assert numbers == [i % 50 for i in range(200)]


def test_fingerprints(spark):
    found = gray.simhash_components(frame(spark)).collect()
    assert len(found) == len(ROWS)
    by_id = {r["doc_id"]: r["fingerprint"] for r in found if r["doc_id"] is not None}
    for doc_id, text, *_ in ROWS:
        if doc_id is not None:
            assert by_id[doc_id] == f"{simhash(text):016x}"


def test_gray_rank_orders_neighbours_by_one_bit():
    codes = np.array([i ^ (i >> 1) for i in range(4096)], np.uint64)
    assert (gray.gray_rank(codes) == np.arange(4096)).all()


@pytest.mark.parametrize("cfg", [
    gray.SimHashConfig(),
    gray.SimHashConfig(fanout=3, queries=50, index_rows=100),
    gray.SimHashConfig(bucket_rows=20),
    gray.SimHashConfig(blocks=6),
    gray.SimHashConfig(max_bits=1, blocks=3),
])
def test_links_equal_brute_force(spark, cfg):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):  # chains and dense balls around centres, in few buckets
        code = rng.getrandbits(10) << 54 | rng.getrandbits(12)
        for _ in range(rng.choice([1, 3, 40])):
            fps.add(code)
            code ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 5])))
    fps |= {0, 1, 3, (1 << 64) - 1, 1 << 63}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = gray.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), cfg)
    links = [(r["a"], r["b"]) for r in found.collect()]
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    true = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bits(a, b) <= cfg.max_bits]
    assert groups(links, signed) == groups(true, signed)


def test_one_document_of_each_group_stays(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = {r["doc_id"]: simhash(r["text"]) for r in docs.collect()}
    ids = sorted(prints)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 3]
    component = groups(links, ids)
    found = gray.simhash_components(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == component
    kept = gray.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(component.values()))


def test_near_copies_of_hard_rows(spark):
    kept = gray.drop_near_duplicates(frame(spark)).collect()
    texts = {simhash(r[1]) for r in ROWS}
    links = [(a, b) for a in texts for b in texts if a < b and (a ^ b).bit_count() <= 3]
    assert len(kept) == len(set(groups(links, texts).values()))
