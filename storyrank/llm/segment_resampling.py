"""Importance resampling towards a target distribution, with segments counted once.

Documents are drawn by the ratio of two hashed n-gram distributions, that of a target table and
that of the corpus (Xie et al., 2023: data selection by importance resampling), with Gumbel noise
from a hash of the id, so that the highest scores are a draw without replacement. Words end at a
newline, so newlines cut a text into lines whose features do not depend on what stands around
them. Each distinct line of the corpus is counted once and multiplied by its occurrences; the
pairs of words that span two lines are added for each text on their own. Scoring does the same for
the lines of a batch.

Rows: one for each document. A null or empty text has no words: no features, weight 0, never
drawn. A null id is hashed as an empty one and ranks before others at a tie of scores; rows that
tie in score and id rank in any order. Repeated rows are documents of their own. Columns of the
input travel in the struct `row`, so that none can clash. Empty tables: no documents give no rows,
an empty target has no features. Texts of any length are read whole, line by line.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyrank.llm.common import small_batches
from storyrank.operators.prefix import running_totals
from storyrank.sources.scratch import stored


@dataclass(frozen=True)
class ResampleConfig:
    """Features are runs of one and two words. `share`: drawn percent of the documents with at
    least `min_words` words."""

    buckets: int = 10_000
    min_words: int = 20
    share: int = 25
    seed: int = 7


# letters and digits stay, capitals become small, bytes above ASCII belong to words
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz\n"
_SIGNS = bytes(
    b if b >= 0x80 or b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def lines_of(text: bytes) -> list[list[bytes]]:
    """Words of each line that has any."""
    cut = [line.split() for line in text.translate(_SIGNS).split(b"\n")]
    return [words for words in cut if words]


def line_codes(words: Sequence[bytes]) -> list[int]:
    """Checksums of the words of a line, then of its pairs of neighbours."""
    ones = list(map(crc32, words))
    return ones + list(map(crc32, [b" " + w for w in words[1:]], ones))


def crossing_codes(lines: Sequence[Sequence[bytes]]) -> list[int]:
    """Checksums of the pairs that the ends of lines part."""
    return [crc32(b" " + b[0], crc32(a[-1])) for a, b in zip(lines, lines[1:])]


def bucket_counts(texts: DataFrame, column: str, cfg: ResampleConfig = ResampleConfig()) -> np.ndarray:
    """How many features of all texts fall in each bucket; as many numbers as there are buckets."""
    small_batches(texts.sparkSession)
    buckets = cfg.buckets

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crossing = np.zeros(buckets, np.int64)
        for batch in batches:
            seen: Counter[bytes] = Counter()
            codes: list[int] = []
            for text in batch.column(0).drop_null().to_pylist():
                lines = lines_of(text)
                seen.update(map(b" ".join, lines))
                codes += crossing_codes(lines)
            crossing += _histogram(codes, buckets)
            yield _segments(list(seen), None, list(seen.values()))
        used = np.flatnonzero(crossing)
        yield _segments(None, used, crossing[used])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            times = batch.column(2).to_numpy(zero_copy_only=False)
            whole = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))
            np.add.at(total, batch.column(1).drop_null().to_numpy(), times[whole])
            codes, sizes = _codes(batch.column(0).drop_null().to_pylist())
            lines = np.flatnonzero(batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            np.add.at(total, codes % buckets, np.repeat(times[lines], sizes))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used.astype(np.int32)), "n": pa.array(total[used])})

    raw = texts.select(F.col(column).cast("binary").alias("text"))
    parts = raw.mapInArrow(cut, "line binary, bucket int, n long")
    distinct = parts.groupBy("line", "bucket").agg(F.sum("n").alias("n"))
    summed = distinct.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in summed.collect():
        out[row["bucket"]] = row["n"]
    return out


def _segments(lines, buckets, times) -> pa.RecordBatch:
    n = len(times)
    return pa.RecordBatch.from_arrays(
        [
            pa.nulls(n, pa.binary()) if lines is None else pa.array(lines, pa.binary()),
            pa.nulls(n, pa.int32()) if buckets is None else pa.array(np.asarray(buckets, np.int32)),
            pa.array(times, pa.int64()),
        ],
        ["line", "bucket", "n"],
    )


def _codes(lines: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Checksums of all features of joined lines, and how many each line has."""
    codes: list[int] = []
    sizes = []
    for line in lines:
        own = line_codes(line.split())
        codes += own
        sizes.append(len(own))
    return np.array(codes, np.int64), np.array(sizes, np.int64)


def _histogram(codes: Sequence[int], buckets: int) -> np.ndarray:
    return np.bincount(np.array(codes, np.int64) % buckets, minlength=buckets)


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of (smoothed share in the target / smoothed share in the corpus))."""
    m = len(corpus)
    s_all, t_all = int(corpus.sum()) + m, int(target.sum()) + m
    ratio = [float((int(t) + 1) * s_all) / float((int(s) + 1) * t_all) for s, t in zip(corpus, target)]
    return np.array([math.floor(1000.0 * math.log(r)) for r in ratio], np.int64)


def _measured(gains: np.ndarray):
    """Column function: (words, sum of gains of the features) of a text in bytes."""
    buckets = len(gains)

    @F.arrow_udf("struct<words:long,gain:long>")
    def measure(texts: pa.Array) -> pa.Array:
        place: dict[bytes, int] = {}
        size: list[int] = []
        codes: list[int] = []
        at: list[int] = []
        crossing: list[int] = []
        n_lines, n_crossing, n_words = [], [], []
        for text in texts.to_pylist():
            lines = lines_of(text or b"")
            for words in lines:
                line = b" ".join(words)
                known = place.setdefault(line, len(place))
                if known == len(size):
                    own = line_codes(words)
                    codes += own
                    size.append(len(own))
                at.append(known)
            own = crossing_codes(lines)
            crossing += own
            n_lines.append(len(lines))
            n_crossing.append(len(own))
            n_words.append(sum(map(len, lines)))
        of_line = _run_sums(gains[np.array(codes, np.int64) % buckets], size)
        total = _run_sums(of_line[np.array(at, np.int64)], n_lines)
        total += _run_sums(gains[np.array(crossing, np.int64) % buckets], n_crossing)
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(total)], ["words", "gain"])

    return measure


def _run_sums(values: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """Sums of consecutive runs of the given sizes."""
    ends = np.cumsum(np.array(sizes, np.int64))
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[ends] - sums[ends - np.array(sizes, np.int64)]


def gumbel_thousandths(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256 of `seed:id`."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    cfg: ResampleConfig = ResampleConfig(),
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """(row, n_features, n_words, weight, score, rank) of each document (doc_id, text, ...).

    `row` holds the columns of `keep`, which only travel with their document. `weight` is the
    floored mean gain of its features, `score` adds the noise, `rank` counts the drawn ones from 1
    and is null for others.
    """
    gains = bucket_gains(bucket_counts(docs, "text", cfg), bucket_counts(target, "text", cfg))
    own = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in keep]).alias("row")
    found = docs.select(own, F.col("doc_id").alias("id"), _measured(gains)(F.col("text").cast("binary")).alias("m"))
    n, gain = F.col("m.words"), F.col("m.gain")
    n_features = F.greatest(2 * n - 1, F.lit(0))
    # whole numbers throughout: what is left over goes first, so that the quotient is floored
    floored = F.expr("(m.gain - pmod(m.gain, 2 * m.words - 1)) div (2 * m.words - 1)")
    weight = F.when(n == 0, 0).otherwise(floored)
    scored = stored(
        found.select(
            "row", "id", n.alias("n_words"), n_features.cast("long").alias("n_features"),
            weight.cast("long").alias("weight"),
            (weight + gumbel_thousandths(F.col("id"), cfg.seed)).cast("long").alias("score"),
        ),
        "resample-scores",
    )
    long_enough = F.col("n_words") >= cfg.min_words
    quota = scored.filter(long_enough).count() * cfg.share // 100
    ordered = scored.filter(long_enough).select(
        "*", (-F.col("score")).alias("down"), F.lit(1).cast("long").alias("one"),
        F.monotonically_increasing_id().alias("tie"),
    )
    placed = running_totals(ordered, ["down", "id", "tie"], ["one"])
    rank = F.when(F.col("one_before") < quota, F.col("one_before") + 1)
    columns = ["row", "n_features", "n_words", "weight", "score"]
    drawn = placed.select(*columns, rank.cast("long").alias("rank"))
    return drawn.unionByName(
        scored.filter(~long_enough).select(*columns, F.lit(None).cast("long").alias("rank"))
    )
