from __future__ import annotations

import datetime
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from storyrank.config import CleanConfig
from storyrank.functions import text, vectors
from storyrank.functions.stopwords import BASE_STOP_WORDS, EXTRA_STOP_WORDS
from storyrank.operators.clean import clean_posts


def cleaned(spark, posts, cfg=CleanConfig(), **lexicons):
    df = spark.createDataFrame(list(enumerate(posts)), "id_str int, tweet string")
    rows = clean_posts(df, cfg, **lexicons).orderBy("id_str").collect()
    return [r["words"] for r in rows]


@pytest.mark.parametrize(
    "post, words",
    [
        ("RT @a: Big #news today http://x.y Budget", ["big", "today", "budget"]),
        ('"@ann says', ["ann", "says"]),
        ("alpha #beta　gamma", ["alpha", "gamma"]),
        ("we saw it go far", ["saw", "far"]),
        ("café 4you naïve", ["caf"]),
        ("RT @a #b", []),
        ("rt. art rt x@y", ["art"]),
        ("", []),
        (None, []),
    ],
)
def test_cleaning(spark, post, words):
    assert cleaned(spark, [post]) == [words]


def model_words(post: str) -> list[str]:
    kept = []
    for token in post.lower().split():
        if token[0] in "@#" or token.startswith("http") or token == "rt":
            continue
        kept.append(token)
    return re.findall("[a-z]+", " ".join(kept))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.text(alphabet="aZrth p@#:/.\t\n\x1c\x85  　é4-", max_size=40), min_size=1, max_size=60
    )
)
def test_plain_words_follow_the_rules(spark, posts):
    assert cleaned(spark, posts, CleanConfig(remove_stop=False)) == [model_words(p) for p in posts]


def test_lexicons(spark):
    lemmas = spark.createDataFrame(
        [("running", "v", "run"), ("said", "v", "say"), ("geese", "n", "goose"), ("goose", "v", "goo"), ("axes", "n", "ax")],
        "token string, pos string, lemma string",
    )
    posts = ["running geese said axes hello"]
    on = CleanConfig(lemmatise=True)
    assert cleaned(spark, posts, on, lemmas=lemmas) == [["run", "goo", "say", "hello"]]
    stems = spark.createDataFrame([("hello", "hell"), ("said", "sa")], "token string, stem string")
    assert cleaned(spark, posts, CleanConfig(stem=True), stems=stems) == [["running", "geese", "axes", "hell"]]
    off = CleanConfig(remove_stop=False)
    assert cleaned(spark, posts, off, lemmas=lemmas) == [["running", "geese", "said", "axes", "hello"]]
    for asked in (on, CleanConfig(stem=True)):
        with pytest.raises(ValueError, match="table is missing"):
            cleaned(spark, posts, asked)


def test_stop_word_lists(spark):
    assert sorted(BASE_STOP_WORDS) == sorted(StopWordsRemover.loadDefaultStopWords("english"))
    assert len(EXTRA_STOP_WORDS) == 120
    assert len(set(EXTRA_STOP_WORDS)) == 119


def test_term_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "b"],), ([],), (["x"],)], "w array<string>")
    got = [[(c["term"], c["tf"]) for c in r[0]] for r in df.select(text.term_counts(F.col("w"))).collect()]
    assert got == [[("a", 1), ("b", 3), ("c", 1)], [], [("x", 1)]]


def test_formats(spark):
    df = spark.createDataFrame(
        [("Sat Jan 14 03:25:04 +0000 2017", "might’ve é", 0.12349), ("no time", "", 2.0)],
        "ctime string, t string, d double",
    )
    rows = df.select(
        text.status_time(F.col("ctime")).alias("at"), text.ascii_only(F.col("t")).alias("t"), text.fixed3(F.col("d")).alias("d")
    ).collect()
    assert rows[0]["at"] == datetime.datetime(2017, 1, 14, 3, 25, 4)
    assert rows[1]["at"] is None
    assert [r["t"] for r in rows] == ["mightve ", ""]
    assert [r["d"] for r in rows] == ["0.123", "2.000"]


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([0.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>")
    rows = df.select(
        vectors.euclidean(F.col("a"), F.col("b")).alias("d"),
        vectors.unit(F.col("a")).alias("u"),
        vectors.argmax(F.col("b")).alias("m"),
        vectors.dot(F.col("a"), F.col("a")).alias("aa"),
    ).collect()
    assert [r["d"] for r in rows] == [5.0, 2.0]
    assert [r["u"] for r in rows] == [[0.6, 0.8], [0.0, 0.0]]
    assert [r["m"] for r in rows] == [0, 1]
    assert [r["aa"] for r in rows] == [25.0, 0.0]
