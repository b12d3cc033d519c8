"""Toxicity by maximum-scoring segments of token log-odds.

Token log-odds of labelled toxic against clean texts are smoothed by Dirichlet priors, the rates of
the whole corpus; a word of which the labels say nothing scores by its stem. A linear-time scan
(Ruzzo and Tompa, 1999) finds all maximal-scoring passages of a text. Scores of passages follow an
extreme-value law in clean texts (Karlin and Altschul, 1990): its slope comes from the token
scores, its size from held-back clean texts, and each passage counts by what it exceeds it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyrank.llm.common import small_batches
from storyrank.sources.scratch import stored

PIECE = re.compile(r"[^ \t-\r]+")
FOLDS = 5
# fixed values: marks and digits around a word
MARKS = "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~«»“”„‘’‚…–—¿¡、。，！？"


@dataclass(frozen=True)
class ToxicConfig:
    """`labels`: most labelled rows that are used, those of smallest hash. `word_bits` and
    `stem_bits` fix the size of the token table; tokens of one bucket share their counts."""

    labels: int = 500_000
    word_bits: int = 20
    stem_bits: int = 18
    stem_letters: tuple[int, ...] = (7, 6, 5, 4)
    prior: float = 2_000.0
    least_z: float = 2.5
    token_cost: float = 0.2
    passages: float = 0.05
    block: int = 4_096

    @property
    def words(self) -> int:
        return 1 << self.word_bits

    @property
    def size(self) -> int:
        return self.words + (1 << self.stem_bits)


# ----------------------------------------------------------------------------- tokens


def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Tokens of all texts as numbers of distinct ones, where each text begins, and these.

    A token is a lower-cased piece between ASCII white space; a null text has none.
    """
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy()
    firsts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    empty = pc.index(names, "").as_py()
    if empty >= 0:  # white space at the ends of a text leaves empty pieces
        kept = codes != empty
        firsts = np.concatenate([[0], np.cumsum(kept)])[firsts]
        codes = codes[kept]
    return codes, firsts, names


def buckets(names: pa.Array, cfg: ToxicConfig) -> np.ndarray:
    """One row per token: bucket of its word, then of the word's stems from the longest, -1 where
    there is none. The word is the token without the marks and digits at its ends."""
    words = pc.utf8_trim(names, characters=MARKS)
    letters = pc.utf8_length(words).to_numpy()
    out = np.full((len(names), 1 + len(cfg.stem_letters)), -1, np.int64)
    own = np.fromiter((zlib.crc32(w.encode()) for w in words.to_pylist()), np.int64, len(words))
    out[:, 0] = np.where(letters > 0, own & (cfg.words - 1), -1)
    for column, size in enumerate(cfg.stem_letters, 1):
        coded = pc.utf8_slice_codeunits(words, 0, size).dictionary_encode()
        stems = coded.dictionary.to_pylist()
        hashed = np.fromiter((zlib.crc32(x.encode(), size) for x in stems), np.int64, len(stems))
        place = cfg.words + (hashed & ((1 << cfg.stem_bits) - 1))
        if len(names):
            out[:, column] = np.where(letters > size, place[coded.indices.to_numpy()], -1)
    return out


def scores_of(names: pa.Array, table: np.ndarray, cfg: ToxicConfig) -> np.ndarray:
    """Score of each token: the first of its buckets that says something, else the common cost."""
    out = np.zeros(len(names), np.float32)
    for column in buckets(names, cfg).T:
        out = np.where((out == 0) & (column >= 0), table[column], out)
    return np.where(out == 0, np.float32(-cfg.token_cost), out)


# ------------------------------------------------------------------------------ model


def bucket_counts(docs: DataFrame, cfg: ToxicConfig) -> np.ndarray:
    """Tokens by bucket in all texts, in toxic and in clean ones: three rows of fixed length.

    `docs`: text, toxic (null where the label is not used). Tasks add up their own texts; blocks of
    buckets are summed after one shuffle. Words count once per text, so that one very long text or
    repetition weighs no more than others.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, cfg.size), np.uint32)
        for batch in batches:
            codes, firsts, names = pieces(batch.column(0))
            # each token once per text
            text = np.repeat(np.arange(batch.num_rows), np.diff(firsts))
            text, codes = np.divmod(np.unique(text * max(len(names), 1) + codes), max(len(names), 1))
            toxic = batch.column(1).fill_null(-1).to_numpy()[text]
            places = buckets(names, cfg)
            for row, chosen in ((0, codes), (1, codes[toxic == 1]), (2, codes[toxic == 0])):
                uses = np.bincount(chosen, minlength=len(names)).astype(np.uint32)
                for column in places.T:
                    held = (column >= 0) & (uses > 0)
                    np.add.at(total[row], column[held], uses[held])
        yield from _blocks(total, cfg)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(payload.as_buffer(), np.uint32).astype(np.int64)
                sums[block] = sums[block] + part if block in sums else part
        if sums:
            yield _payloads(list(sums), [s.tobytes() for s in sums.values()])

    parts = docs.select("text", "toxic").mapInArrow(count, "block int, payload binary")
    summed_up = parts.repartition("block").mapInArrow(summed, "block int, payload binary")
    total = np.zeros((3, cfg.size), np.int64)
    for row in summed_up.toLocalIterator():  # fixed size: three numbers for each bucket
        begin = row["block"] * cfg.block
        part = np.frombuffer(row["payload"], np.int64).reshape(3, -1)
        total[:, begin : begin + part.shape[1]] = part
    return total


def _blocks(total: np.ndarray, cfg: ToxicConfig) -> Iterator[pa.RecordBatch]:
    for begin in range(0, cfg.size, cfg.block):
        part = total[:, begin : begin + cfg.block]
        if part.any():
            yield _payloads([begin // cfg.block], [part.tobytes()])


def _payloads(blocks: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    arrays = [pa.array(blocks, pa.int32()), pa.array(payloads, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["block", "payload"])


def token_scores(counts: np.ndarray, cfg: ToxicConfig) -> tuple[np.ndarray, float]:
    """Score of each bucket and the slope of the extreme-value law of clean texts.

    A bucket scores its log-odds where they are significant, but never between zero and the cost of
    an ordinary token; zero marks one that says nothing, whose words ask their next shorter stem.
    """
    scores, slope = np.zeros(cfg.size, np.float32), 1.0
    if counts[1].any() and counts[2].any():
        words, stems = slice(0, cfg.words), slice(cfg.words, cfg.size)
        scores[stems], _ = _log_odds(counts[:, stems], cfg)
        scores[words], clean_rate = _log_odds(counts[:, words], cfg)
        slope = _slope(np.where(scores[words] == 0, -cfg.token_cost, scores[words]), clean_rate)
    return scores, slope


def _log_odds(counts: np.ndarray, cfg: ToxicConfig) -> tuple[np.ndarray, np.ndarray]:
    """Significant log-odds of toxic against clean, zero elsewhere; smoothed rate in clean texts.

    The Dirichlet prior of a bucket is its rate in the whole corpus, as if seen in `prior` tokens.
    """
    everywhere = (counts[0] + 0.5) / (counts[0] + 0.5).sum()
    seen = [counts[i] + cfg.prior * everywhere for i in (1, 2)]
    rates = [s / s.sum() for s in seen]
    odds = np.log(rates[0]) - np.log(rates[1])
    z = odds / np.sqrt(1 / seen[0] + 1 / seen[1])
    toxic = np.where((odds > cfg.token_cost) & (z >= cfg.least_z), odds, 0.0)
    return np.where(z <= -cfg.least_z, np.minimum(odds, -cfg.token_cost), toxic), rates[1]


def _slope(scores: np.ndarray, rate: np.ndarray) -> float:
    """Positive root of sum(rate * exp(slope * score)) = 1."""
    rate = rate / rate.sum()
    low, high = 0.0, 1.0
    excess = lambda x: float((rate * np.exp(np.minimum(x * scores, 500.0))).sum()) - 1.0
    while excess(high) < 0 and high < 64:
        low, high = high, 2 * high
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (low, middle) if excess(middle) > 0 else (middle, high)
    return high


# ------------------------------------------------------------------------------- scan


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, after last, score) in linear time.

    Only positive tokens can begin or end one, so the stack holds runs between them.
    """
    gains = np.flatnonzero(scores > 0)
    if not len(gains):
        return []
    running = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    # entries: first, after last, sum before, sum after, nearest earlier entry of smaller sum before
    stack: list[tuple[int, int, float, float, int]] = []
    for at in gains.tolist():
        first, before, after = at, running[at], running[at + 1]
        back = len(stack) - 1
        while True:
            while back >= 0 and stack[back][2] >= before:
                back = stack[back][4]
            if back < 0 or stack[back][3] >= after:
                stack.append((first, at + 1, before, after, back))
                break
            first, before = stack[back][0], stack[back][2]
            back_of = stack[back][4]
            del stack[back:]
            back = back_of
    return [(a, b, float(d - c)) for a, b, c, d, _ in stack]


def scanned(docs: DataFrame, table: np.ndarray, cfg: ToxicConfig) -> DataFrame:
    """Add n_tokens and passages (start, stop, score; code points of the text) to `docs`."""
    shipped = docs.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("struct<n_tokens: long, passages: array<struct<start: int, stop: int, score: double>>>")
    def scan(texts: pa.Array) -> pa.Array:
        codes, firsts, names = pieces(texts)
        scores = scores_of(names, shipped.value, cfg)[codes] if len(names) else np.zeros(0, np.float32)
        gains = np.concatenate([[0], np.cumsum(scores > 0)])[firsts]
        found: list[list] = [[] for _ in range(len(texts))]
        for i in np.flatnonzero(np.diff(gains)).tolist():
            segments = maximal_segments(scores[firsts[i] : firsts[i + 1]])
            found[i] = _in_text(texts[i].as_py(), segments)
        sizes = np.diff(firsts)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(found, kind)], ["n_tokens", "passages"]
        )

    return docs.withColumn("scan", scan("text"))


def _in_text(text: str, segments: list[tuple[int, int, float]]) -> list[tuple]:
    """Segments of tokens as spans of the text."""
    spans = [m.span() for m in PIECE.finditer(text)]
    return [(spans[a][0], spans[b - 1][1], score) for a, b, score in segments]


# --------------------------------------------------------------------------- operator


def fold(id_: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def score_texts(
    df: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    cfg: ToxicConfig = ToxicConfig(),
) -> DataFrame:
    """All columns of `df` as `row`, then held_out, score, predicted, passages.

    `labels`: doc_id and toxic; ids of fold 0 are never used. Words are learned from folds 1 to 3 and
    the law is fitted on fold 4. A null or empty text has no passage and gets the lowest score; so
    has every text when the labels lack one of the classes. Null labels and ids are ignored, an id
    with two labels counts as toxic. An empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    usable = labels.select(F.col("doc_id").cast("string").alias("key"), "toxic").dropna()
    learned = usable.filter(fold(F.col("key")) != 0).groupBy("key").agg(F.max("toxic").alias("toxic"))
    sample = stored(learned.orderBy(F.xxhash64("key"), "key").limit(cfg.labels), "labels")
    docs = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.col(text_col).alias("text"),
        F.col(id_col).cast("string").alias("key"),
    )
    # at most cfg.labels rows of an id and a label
    marked = docs.join(F.broadcast(sample), "key", "left").withColumn("fold", fold(F.col("key")))
    fitted = marked.withColumn("toxic", F.when(F.col("fold") < FOLDS - 1, F.col("toxic")))
    table, slope = token_scores(bucket_counts(fitted, cfg), cfg)

    scan = scanned(marked.drop("row"), table, cfg).select("key", "fold", "toxic", "scan.*")
    best = F.coalesce(F.array_max(F.transform("passages", lambda p: p["score"])), F.lit(0.0))
    held = stored(scan.filter((F.col("fold") == FOLDS - 1) & F.col("toxic").isNotNull())
                  .withColumn("best", best), "held-back")
    clean = held.filter(F.col("toxic") == 0).agg(
        F.count("*").alias("n"), F.sum(F.col("n_tokens") * F.exp(-slope * F.col("best"))).alias("s")
    ).first()
    size = (clean["n"] + 1) / ((clean["s"] or 0.0) + 1)
    cut = _cut(held.select("toxic", F.rint(evidence(slope, size, cfg) * 4).alias("step")))

    scored = scanned(docs, table, cfg).select("row", "key", "scan.*")
    score = 1 / (1 + F.exp(cut - evidence(slope, size, cfg)))
    return scored.select(
        "row",
        (fold(F.col("key")) == 0).alias("held_out"),
        score.alias("score"),
        F.when(score >= 0.5, 1).otherwise(0).alias("predicted"),
        significant(slope, size, cfg).alias("passages"),
    )


def excess(slope: float, size: float, p: Column) -> Column:
    """By how much a passage exceeds what a clean text of this length would have."""
    return slope * p["score"] - F.log(size * F.greatest(F.col("n_tokens"), F.lit(1)))


def significant(slope: float, size: float, cfg: ToxicConfig) -> Column:
    """Passages whose chance in a clean text is at most `passages`."""
    least = float(-np.log(-np.log1p(-cfg.passages)))
    return F.filter("passages", lambda p: excess(slope, size, p) >= least)


def evidence(slope: float, size: float, cfg: ToxicConfig) -> Column:
    """Sum over the passages of what they exceed; between -20 and 200."""
    parts = F.transform("passages", lambda p: F.greatest(excess(slope, size, p), F.lit(0.0)))
    whole = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
    return F.least(F.greatest(whole, F.lit(-20.0)), F.lit(200.0))


def _cut(steps: DataFrame) -> float:
    """Evidence that best parts held-back toxic texts from clean ones; middle of the best range."""
    rows = steps.groupBy("step").agg(
        F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean")
    ).orderBy("step").collect()  # at most one row for each quarter of a unit
    if not any(r["toxic"] for r in rows):
        return 3.0
    wrong, best, ends = sum(r["clean"] for r in rows), None, None
    for here, after in zip(rows, [*rows[1:], None]):
        wrong += here["toxic"] - here["clean"]
        end = here["step"] + 12 if after is None else after["step"]
        if best is None or wrong < best:
            best, ends = wrong, (here["step"], end)
    return (ends[0] + ends[1]) / 8
