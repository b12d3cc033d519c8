from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyrank.llm import queries
from storyrank.llm import string_kernels as lang
from tests.llm.helpers import LONG, ROWS, frame

SYLLABLES = {"xx": ["ka", "to", "mi", "ren"], "yy": ["blu", "gro", "sti", "mi"], "zz": ["жа", "ко", "ти", "на"]}


def held_out(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 == 2


def plain_runs(text):
    row, out = [" "], set()
    for sign in text:
        if sign.isalpha():
            row.append(sign.lower() if len(sign.lower()) == 1 else sign)
        elif row[-1] != " ":
            row.append(" ")
    if row[-1] != " ":
        row.append(" ")
    if row == [" "]:
        return out
    for size in (1, 2, 3):
        out |= {"".join(row[i : i + size]) for i in range(len(row) - size + 1)}
    return out - {" "}


def plain_predictions(rows, train, cfg):
    """Kernel ridge regression on whole kernel matrices, runs as strings."""
    learned = sorted({(r[2], r[1]) for r in train})
    names = sorted({name for name, _ in learned})
    sets = [plain_runs(t) for _, t in learned]
    kernel = lambda a, b: len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    values, turn = np.linalg.eigh(k)
    strong = values > 1e-10 * values[-1]
    half = turn[:, strong] / np.sqrt(values[strong])
    f = k @ half
    label = np.array([names.index(name) for name, _ in learned])
    weight = 1.0 / np.bincount(label)[label]
    y = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    gram = (f * weight[:, None]).T @ f
    w = np.linalg.solve(gram + cfg.ridge * np.trace(gram) / len(gram) * np.eye(len(gram)), (f * weight[:, None]).T @ y)
    out = []
    for r in rows:
        own = plain_runs(r[1] or "")
        if not own:
            out.append((r[0], "und", 0.0))
            continue
        value = np.array([kernel(own, s) for s in sets]) @ half @ w
        out.append((r[0], names[value.argmax()], float(np.clip((value.max() + 1) / 2, 0, 1))))
    return out


def texts(n, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[name], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 30))]
        rows.append((i, " ".join(words), name, "s", 1))
    return rows


@pytest.mark.parametrize("text", ["Ab, c!", "", "12 _", "a", "ÀÉ ß İx", "x" * 50, "日本 語\n", "\U0001f600a\U00020000b"])
@pytest.mark.parametrize("stretch", [1 << 20, 3])
def test_runs_equal_sets_of_strings(text, stretch):
    code = lambda run: sum(ord("\1" if c == " " else c) << 21 * (len(run) - 1 - i) for i, c in enumerate(run))
    assert lang.runs(text, 3, stretch).tolist() == sorted(map(code, plain_runs(text)))


def test_equals_kernel_ridge_regression_on_whole_matrices(spark):
    rows = texts(150)
    train = [r for r in rows if not held_out(r[0])]
    cfg = lang.LanguageConfig(landmarks=1_000)
    found = lang.identify_languages(frame(spark, rows), cfg).collect()
    got = {r["row"]["doc_id"]: (r["lang_pred"], r["score"]) for r in found}
    for doc_id, name, score in plain_predictions(rows, train, cfg):
        assert got[doc_id][0] == name and got[doc_id][1] == pytest.approx(score, abs=1e-5)


def test_few_landmarks_find_held_out_languages(spark):
    rows = texts(600)
    found = lang.identify_languages(frame(spark, rows), lang.LanguageConfig(landmarks=5, train_texts=60)).collect()
    truth = {r[0]: r[2] for r in rows}
    out = [r for r in found if r["held_out"]]
    assert len(out) == sum(held_out(r[0]) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["row"]["doc_id"]] for r in out]) > 0.97


def test_held_out_labels_are_not_read(spark):
    rows = texts(200)
    other = [(i, t, "zz" if held_out(i) else name, "q", 7) for i, t, name, _, _ in rows]
    order = lambda df: sorted((r["row"]["doc_id"], r["lang_pred"], r["score"]) for r in df.collect())
    one, two = (order(lang.identify_languages(frame(spark, r))) for r in (rows, other))
    assert [r[:2] for r in one] == [r[:2] for r in two]
    assert [r[2] for r in one] == pytest.approx([r[2] for r in two], abs=1e-9)


def test_sample_is_bounded_and_folds_copies(spark):
    rows = texts(400) + [(1_000 + i, "kato miren", "xx", "s", 1) for i in range(500)]
    sample = lang.training_sample(frame(spark, rows), lang.LanguageConfig(train_texts=20)).collect()
    assert len({(r["lang"], r["text"]) for r in sample}) == len(sample)
    assert {n: sum(r["lang"] == n for r in sample) for n in SYLLABLES} == {n: 20 for n in SYLLABLES}


def test_hard_rows(spark):
    rows = ROWS + [(30, "123 ...", "en", "a", 7), (31, "é" * 3, None, "a", 3), (32, "\x00", "de", None, 1)]
    df = frame(spark, rows, extra=("lang_pred", "score", "held_out", "row", "h", "t"))
    found = lang.identify_languages(df).collect()
    assert sorted(str(r["row"]["doc_id"]) for r in found) == sorted(str(r[0]) for r in rows)
    learned = {r[2] for r in rows if r[0] is not None and r[2] and plain_runs(r[1] or "") and not held_out(r[0])}
    for r in found:
        assert r["held_out"] == held_out(r["row"]["doc_id"]) and r["row"]["score"] == "own score"
        if plain_runs(r["row"]["text"] or ""):
            assert r["lang_pred"] in learned and 0 <= r["score"] <= 1
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


@pytest.mark.parametrize("rows", [[], [(1, "abc", None, "a", 3), (2, None, "en", "a", 3)]])
def test_nothing_to_learn_from(spark, rows):
    found = lang.identify_languages(frame(spark, rows)).collect()
    assert [(r["lang_pred"], r["score"]) for r in found] == [("und", 0.0)] * len(rows)


def test_only_long_texts_leave_no_landmark(spark):
    rows = [(i, LONG, name, "a", 1) for i, name in enumerate(["en", "de", "en", "de", "en"])]
    found = lang.identify_languages(frame(spark, rows)).collect()
    assert {r["lang_pred"] for r in found} <= {"de", "en"} and {r["score"] for r in found} == {0.5}


def test_query_on_the_tables(spark, sf_dir):
    found = queries.QUERIES["op11_string_kernels"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    rows = found.join(docs, "doc_id").filter(F.col("held_out") & F.col("lang").isNotNull()).collect()
    assert found.count() == docs.count()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
