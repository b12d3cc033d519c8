from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from storyrank.llm import config_packing as packing
from storyrank.llm import token_files
from storyrank.llm.tokens import Encoder, TokenizerSpec
from storyrank.sources.scratch import scratch_path
from tests.llm.helpers import DOCUMENTS, ROWS, crc, frame

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
ODD = [
    "a  b", " x\n\ny ", "foo's ),. bar...", "İΣΣ ΑΣ. ñ é  x\tz", "",
    "a\n b c\n", " lead", "don't, WE'RE 123,456.", "<|endoftext|> x<|endoftext|>y!", "x" * 500 + ".",
    "nul\x00 a\x00", "a  b", "a　b", "x²., ½,.", "\x1c a", "n\r\nx", "Ⅷ.",
    "café.\ncafé,,.\nA\nB C", None, "***", "a*** b_c. d's. e'", "中文 中文。",
]


@pytest.mark.parametrize("name", [WORD, BYTE])
@pytest.mark.parametrize("generation", [10, 300_000])
def test_encoder_equals_the_library(spark, sf_dir, name, generation):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    path = public_tokenizers.path(name)
    plain, ours = Tokenizer.from_file(path), Encoder(TokenizerSpec.read(path))
    ours.GENERATION = generation
    for _ in range(2):
        for begin in range(0, len(ODD + texts), 9):
            part = (ODD + texts)[begin : begin + 9]
            ids, begins = ours.encode(pa.array([None, *part]).slice(1))
            for text, a, b in zip(part, begins, begins[1:]):
                assert ids[a:b].tolist() == plain.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_words_are_encoded_once_whatever_marks_follow(name):
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopé" for c in "qrstuvwxyz"]
    path = public_tokenizers.path(name)
    plain, ours = Tokenizer.from_file(path), Encoder(TokenizerSpec.read(path))
    asked, encoded = [], ours._encoded
    ours._encoded = lambda new: asked.append(len(new)) or encoded(new)
    for mark in [",", "...", "!)", "'", "_", "9.", "é?"]:
        texts = ["x", "", None, " ".join(w + mark for w in words), " ".join(words) + mark]
        ids, begins = ours.encode(pa.array(texts))
        for text, a, b in zip(texts, begins, begins[1:]):
            assert ids[a:b].tolist() == plain.encode(text or "", add_special_tokens=False).ids
        if mark in ("...", "!)"):
            assert asked[-1] < 10
    assert [b - a for a, b in [ours.encode(pa.array(["", None]))[1][:2]]] == [0]


def test_memory_of_words_is_bounded():
    ours = Encoder(TokenizerSpec.read(public_tokenizers.path(BYTE)))
    ours.GENERATION = 50
    for begin in range(0, 400, 30):
        ids, _ = ours.encode(pa.array([" ".join(f"word{i}." for i in range(begin, begin + 70)), "y" * 100]))
        again, _ = ours.encode(pa.array([" ".join(f"word{i}." for i in range(begin, begin + 70)), "y" * 100]))
        assert ids.tolist() == again.tolist()
        assert 0 < len(ours.known) == len(ours.sizes) <= 50 and ours.sizes.sum() == len(ours.pool)
        assert max(map(len, ours.known.to_pylist())) <= ours.LONGEST_KEPT


def sorted_rows():
    return sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))


def test_files_of_hard_rows(spark):
    path = public_tokenizers.path(WORD)
    folder = scratch_path(spark, "token-test")
    parts = token_files.write_token_files(frame(spark), folder, TokenizerSpec.read(path), 1)
    assert parts == token_files.list_parts(folder)
    found = token_files.read_token_files(spark, folder).orderBy("start").collect()
    plain, start = Tokenizer.from_file(path), 0
    expected = sorted_rows()
    assert [r["doc_id"] for r in found] == [r[0] for r in expected]
    texts = defaultdict(list)
    for doc_id, text, *_ in expected:
        texts[doc_id].append(crc(plain.encode(text or "", add_special_tokens=False).ids + [1]))
    for row in found:
        assert row["start"] == start
        texts[row["doc_id"]].remove(row["ids_crc32"])
        start += row["n_tokens"]
    whole = np.concatenate([np.array(token_files.PartReader(folder, p).ids) for p in parts])
    assert len(whole) == start and whole.dtype == np.uint16


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    spec = TokenizerSpec.read(public_tokenizers.path(BYTE))
    folder = scratch_path(spark, "token-test")
    assert token_files.write_token_files(empty, folder, spec, 1) == []
    assert token_files.read_token_files(spark, folder).count() == 0
    assert packing.pack_documents(empty, spec, 2).count() == 0


def check_packing(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_pieces_of_hard_rows(spark):
    path = public_tokenizers.path(BYTE)
    rows = packing.pack_documents(frame(spark), TokenizerSpec.read(path), 2).collect()
    assert check_packing(rows, 1024) <= 1 + -(-sum(r["length"] for r in rows) // 1024)
    plain = Tokenizer.from_file(path)
    want = defaultdict(int)
    for doc_id, text, *_ in ROWS:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, piece, a, b - a, crc(ids[a:b])] += 1
    for r in rows:
        want[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] -= 1
    assert not any(want.values())


def test_best_filling_is_the_best():
    rng = np.random.default_rng(3)
    for _ in range(20):
        capacity = 12
        worth = np.where(rng.random(capacity + 1) < 0.5, rng.random(capacity + 1), 0.0)
        worth[0] = 0
        best = [0.0] * (capacity + 1)
        for room in range(1, capacity + 1):
            best[room] = max([best[room - 1]] + [best[room - n] + worth[n] for n in range(1, room + 1)])
        value, filling = packing.best_filling(worth, capacity)
        assert abs(value - best[capacity]) < 1e-9
        assert sum(n * k for n, k in filling.items()) <= capacity
        assert abs(sum(worth[n] * k for n, k in filling.items()) - value) < 1e-9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_plan_needs_no_more_sequences_than_best_fit(spark, sf_dir, sf):
    """On the documents, against plain best-fit-decreasing piece by piece."""
    docs = spark.read.parquet(f"{sf_dir}/../{sf}/documents.parquet").select("text").collect()
    plain = Tokenizer.from_file(public_tokenizers.path(BYTE))
    lengths = []
    for e in plain.encode_batch([r["text"] or "" for r in docs], add_special_tokens=False):
        n = len(e.ids) + 1
        lengths += [1024] * (n // 1024) + [n % 1024] * (n % 1024 > 0)
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else 1024
        bisect.insort(rooms, room - n)
    plan = packing.make_plan(np.bincount(lengths, minlength=1025), packing.PackConfig())
    assert sum(lengths) / 1024 <= plan.sequences <= len(rooms)


@pytest.mark.parametrize("n", [1, 40, 3000, 200_000])
def test_plan_places_all_in_few_sequences(n):
    rng = np.random.default_rng(n)
    lengths = np.minimum(1 + rng.gamma(1.3, 25, n).astype(int), 64)
    counts = np.bincount(lengths, minlength=65)
    plan = packing.make_plan(counts, packing.PackConfig(capacity=64))
    placed = np.zeros(65, np.int64)
    used = np.zeros(plan.sequences, np.int64)
    for length, first, pieces, per, sequence, _ in sorted(plan.runs):
        assert first == placed[length]
        placed[length] += pieces
        np.add.at(used, sequence + np.arange(pieces) // per, length)
    assert (placed == counts).all() and used.max() <= 64 and used.min() > 0
    assert plan.sequences >= plan.bound - 1e-6
    assert plan.sequences <= 1.01 * plan.bound + 2


def test_rows_of_one_id_are_dealt_to_many_parts(spark):
    rows = [(None if i % 3 else 7, f"text {i}", "en", "a", 9) for i in range(3_000)]
    folder = scratch_path(spark, "hot-ids")
    spec = TokenizerSpec.read(public_tokenizers.path(WORD))
    # parts of this size would otherwise be joined again
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        parts = token_files.write_token_files(frame(spark, rows), folder, spec, end_id=1)
    finally:
        spark.conf.unset(setting)
    assert sum(p.docs for p in parts) == 3_000 and max(p.docs for p in parts) < 1_000
    read = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in read] == [None] * 2_000 + [7] * 1_000
