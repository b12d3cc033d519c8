from __future__ import annotations

import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from storyrank.llm import queries
from storyrank.llm import segment_resampling as draw
from tests.llm.helpers import LONG, ROWS, ascii_lower, frame

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORD.findall(ascii_lower(text))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def buckets(texts, m):
    out = [0] * m
    for text in texts:
        for f in features(text)[1]:
            out[zlib.crc32(f.encode()) % m] += 1
    return out


def plain(rows, targets, cfg=draw.ResampleConfig()):
    """[(doc_id, n_features, weight, score, rank)] feature by feature."""
    m = cfg.buckets
    s, t = buckets([r[1] for r in rows], m), buckets(targets, m)
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log(((y + 1) * (all_s + m)) / ((x + 1) * (all_t + m)))) for x, y in zip(s, t)]
    out = []
    for row in rows:
        words, found = features(row[1])
        total = sum(gain[zlib.crc32(f.encode()) % m] for f in found)
        weight = total // len(found) if found else 0
        named = f"{cfg.seed}:{'' if row[0] is None else row[0]}"
        h = int(hashlib.sha256(named.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([row[0], len(found), weight, score, None, len(words)])
    able = [r for r in out if r[5] >= cfg.min_words]
    able.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for place, r in enumerate(able[: cfg.share * len(able) // 100]):
        r[4] = place + 1
    return [tuple(r[:5]) for r in out]


def key(row):
    return tuple((v is not None, v or 0) for v in row)


def got(df, target, cfg=draw.ResampleConfig()):
    rows = draw.resample(df, target, cfg).select("row.doc_id", "n_features", "weight", "score", "rank").collect()
    return sorted(map(tuple, rows), key=key)


def test_lines_and_their_codes():
    text = "A b-C\n\n9é x\r\n, \n z"
    lines = draw.lines_of(text.encode())
    assert lines == [[b"a", b"b", b"c"], [b"9\xc3\xa9", b"x"], [b"z"]]
    codes = [c for words in lines for c in draw.line_codes(words)] + draw.crossing_codes(lines)
    assert sorted(codes) == sorted(zlib.crc32(f.encode()) for f in features(text)[1])


@pytest.mark.parametrize("cfg", [draw.ResampleConfig(), draw.ResampleConfig(min_words=0, share=60, buckets=7, seed=3)])
def test_hard_rows(spark, cfg):
    words = [(20 + i, "gamma delta " * (5 + i) + "\nalpha\nlicence line\n" + "beta\n" * i, "en", "a", 1) for i in range(12)]
    rows = ROWS + words
    target = spark.createDataFrame([(1, "alpha beta\ngamma"), (2, None), (3, ""), (4, LONG[:500])], "item_id long, text string")
    df = frame(spark, rows, extra=("n_words", "weight", "score", "id", "tie", "one", "down", "bucket", "line"))
    want = plain(rows, ["alpha beta\ngamma", None, "", LONG[:500]], cfg)
    assert got(df, target, cfg) == sorted(want, key=key)


def test_repeated_lines_count_each_time(spark):
    rows = [(i, "same line here\n" * (i % 5) + f"own {i % 3}", "en", "a", 1) for i in range(60)]
    df = frame(spark, rows).repartition(7)
    assert list(draw.bucket_counts(df, "text")) == buckets([r[1] for r in rows], 10_000)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, "c " * 30)], "doc_id long, text string")
    assert got(none, some) == []
    assert got(some, none) == sorted(plain([(1, "a b"), (2, "c " * 30)], []), key=key)


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = queries.QUERIES["op12_segment_resampling"](spark, sf_dir)
    assert {t for _, t in found.dtypes} == {"bigint"}
    rows = sorted(map(tuple, found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=key)
    assert rows == sorted(plain([tuple(r) for r in docs], target), key=key)


def test_kept_columns_travel(spark):
    df = frame(spark)
    kept = draw.resample(df, df, keep=["doc_id", "source", "uid"]).select("row.*")
    assert kept.columns == ["doc_id", "source", "uid"] and kept.filter(F.col("uid") == "own uid").count() == len(ROWS)
