from __future__ import annotations

from collections import defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from storyrank.llm import toxic_segments
from storyrank.llm.pfair_mix import MixConfig
from storyrank.sources.scratch import scratch_path
from tests.llm.helpers import DOCUMENTS, ROWS, ascii_lower, crc, frame, groups, simhash
from tests.llm.test_order import plain_mix
from tests.llm.test_tokens import check_packing


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxic_segments.score_texts(docs, labels).collect()
    rows = {r["row"]["doc_id"]: r["row"] for r in scored if not r["predicted"]}
    last = {}
    for i in sorted(rows):
        last[ascii_lower(rows[i]["text"])] = i
    rows = {i: rows[i] for i in last.values()}
    prints = {i: simhash(r["text"]) for i, r in rows.items()}
    ids = sorted(rows)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 3]
    rows = {i: rows[i] for i in set(groups(links, ids).values())}
    order = plain_mix([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows.values()], MixConfig())
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    stage, seen = docs, []
    for _, fn in corpus_pipeline.STAGES[:-1]:
        stage = fn(spark, stage, sf_dir)
        assert stage.columns == docs.columns
        seen.append([r["doc_id"] for r in stage.collect()])
    assert sorted(seen[0]) == sorted(r["row"]["doc_id"] for r in scored if not r["predicted"])
    assert sorted(seen[1]) == sorted(last.values())
    assert sorted(seen[2]) == sorted(rows)
    assert seen[3] == order

    packed = corpus_pipeline.run(spark, sf_dir).collect()
    check_packing(packed, 1024)
    by_doc = defaultdict(list)
    for p in packed:
        by_doc[p["doc_id"]].append(p)
    assert set(by_doc) == set(rows)
    for i, pieces in by_doc.items():
        ids = plain.encode(rows[i]["text"], add_special_tokens=False).ids + [2]
        assert sum(p["length"] for p in pieces) == len(ids)
        assert all(p["ids_crc32"] == crc(ids[p["start"] : p["start"] + p["length"]]) for p in pieces)


def test_hard_rows_pass_all_stages(spark, sf_dir):
    names = ("uid", "row", "size", "_range", "id", "key", "fold")
    stage = frame(spark, extra=names)
    for _, fn in corpus_pipeline.STAGES[:-1]:
        stage = fn(spark, stage, sf_dir)
        assert stage.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
    kept = stage.collect()
    assert 0 < len(kept) <= len({ascii_lower(r[1]) for r in ROWS})
    assert all(r["uid"] == "own uid" for r in kept)
    assert corpus_pipeline.STAGES[-1][1](spark, stage, sf_dir).count() >= len(kept)


def test_no_rows_pass_all_stages(spark, sf_dir):
    stage = spark.createDataFrame([], DOCUMENTS)
    for _, fn in corpus_pipeline.STAGES:
        stage = fn(spark, stage, sf_dir)
        assert stage.count() == 0


def test_sequences_keep_the_order_of_the_mix(spark, sf_dir):
    # three rows of a to one of b up to a point, then b alone; later files are the larger ones
    ids = list(range(30_000))
    source = {i: "a" if i < 20_000 and i % 4 else "b" for i in ids}
    text = {i: "word " * ((7 if source[i] == "a" else 90) + i % 5) for i in ids}
    df = spark.createDataFrame([(i, text[i], "en", source[i], len(text[i])) for i in ids], DOCUMENTS)
    mixed = df.withColumn("part", F.floor(F.sqrt(F.col("doc_id") / 1_000)).cast("int"))
    path = scratch_path(spark, "mixed")
    mixed.repartitionByRange(6, "part").sortWithinPartitions("doc_id").drop("part").write.parquet(path)
    docs = spark.read.parquet(path)
    rows = corpus_pipeline.in_row_order(docs).orderBy("file", "part_of_file", "line").collect()
    assert [r["doc_id"] for r in rows] == ids

    found = corpus_pipeline.packed(spark, docs, sf_dir).collect()
    assert len(found) == len(ids)
    check_packing(found, 1024)
    order = sorted(found, key=lambda r: (r["sequence_id"], r["offset"]))
    assert {r["sequence_id"] for r in found} == set(range(order[-1]["sequence_id"] + 1))
    # a piece stays within its window of 8,192, so shares of sources follow the mix
    assert all(at // 8_192 == r["doc_id"] // 8_192 for at, r in enumerate(order))
    for end in range(8_192, 16_385, 8_192):
        assert sum(source[r["doc_id"]] == "a" for r in order[:end]) == end * 3 // 4
    firsts = {}
    for r in order:
        firsts[r["sequence_id"]] = min(firsts.get(r["sequence_id"], r["doc_id"]), r["doc_id"])
    assert list(firsts.values()) == sorted(firsts.values())
