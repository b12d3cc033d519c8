"""Language identification by blended-spectrum string kernels.

Two texts are as alike as the number of different character runs of one to three signs that both
hold, over the root of what each holds (presence kernels; Ionescu, Popescu and Cahill, 2014).
Landmark texts span the space of the classifier (Nystroem; Williams and Seeger, 2001): with K the
kernel of the landmarks, a text is the vector of its kernel values with them times K^(-1/2), and one
ridge regression per language against all others is fitted to the vectors of the training texts.

The kernel value with a landmark is a product of the 0/1 row of a text's runs and the 0/1 matrix of
the landmarks, so the whole classifier folds into one table of runs by languages, and a batch of
texts is scored by one product of its sparse rows with this table.

Signs: lower case letters, everything else is one blank. Each run of up to three signs is one whole
number, without collisions. Fit: at most `train_texts` texts of each language and `landmarks` of
these, those with the smallest hash of the id; whole texts, landmarks not above `landmark_signs`
characters. Prediction: whole texts, in stretches, of any length.

Rows: one for each document, columns of the input in the struct `row`. A null text, an empty one or
one without a letter is `und` with score 0; so is everything when no labelled text has a letter. A
language takes part if a text of it with a letter is in the training folds. Equal scores: the
language that comes first in the alphabet. Rows without language or with a null id are never learned
from; equal texts of one language are learned once. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyrank.llm.common import row_of, small_batches
from storyrank.operators.topk import top_per_group
from storyrank.sources.scratch import stored

UNKNOWN = "und"
# texts of one matrix product
BLOCK_TEXTS = 64


@dataclass(frozen=True)
class LanguageConfig:
    """`train_texts` and `landmarks` bound the fitting sample, each per language; `longest_run` is
    at most 3."""

    folds: int = 4
    held_out: int = 2
    train_texts: int = 1_000
    landmarks: int = 32
    landmark_signs: int = 4_000
    ridge: float = 1e-3
    longest_run: int = 3
    stretch: int = 1 << 20


# ------------------------------------------------------------------------------- runs

# three signs of 21 bits fit in one whole number; a blank is not zero, so no run reads as a shorter one
_BITS, _BLANK = 21, 1

_TABLE: list[np.ndarray] = []


def _signs_table() -> np.ndarray:
    """Lower case letter of each code point that is a letter, a blank for all others."""
    out = np.full(0x110000, _BLANK, np.int64)
    for point in range(0x110000):
        sign = chr(point)
        if sign.isalpha():
            low = sign.lower()
            out[point] = ord(low) if len(low) == 1 else point
    return out


def signs(text: str) -> np.ndarray:
    """Letters of a text, in lower case, with one blank for each stretch between, before and after."""
    if not _TABLE:
        _TABLE.append(_signs_table())
    found = _TABLE[0][np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    found = np.concatenate([[_BLANK], found, [_BLANK]])
    return found[np.append(True, (found[1:] != _BLANK) | (found[:-1] != _BLANK))]


def runs(text: str, longest: int, stretch: int = 1 << 20) -> np.ndarray:
    """Different runs of one to `longest` signs as rising whole numbers; none without a letter."""
    row = signs(text)
    if len(row) == 1:
        return np.zeros(0, np.int64)
    parts = []
    for begin in range(0, len(row), stretch):
        own = row[begin : begin + stretch + longest - 1]
        made = own
        parts.append(_distinct(made))
        for size in range(1, longest):
            made = (made[:-1] << _BITS) | own[size:]
            parts.append(_distinct(made))
    out = _distinct(np.concatenate(parts))
    return out[out != _BLANK]


def _distinct(codes: np.ndarray) -> np.ndarray:
    codes = np.sort(codes)
    return codes[np.append(True, codes[1:] != codes[:-1])] if len(codes) else codes


def _places(codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the rising `codes`, whether it is there) of each wanted code."""
    at = np.searchsorted(codes, wanted)
    at[at == len(codes)] = 0
    return at, codes[at] == wanted


# ------------------------------------------------------------------------------ model


@dataclass(frozen=True)
class LanguageModel:
    """`table` has a row for each of the rising `codes` and a column for each language."""

    languages: tuple[str, ...]
    codes: np.ndarray
    table: np.ndarray
    cfg: LanguageConfig

    def decide(self, rows: Sequence[np.ndarray]) -> np.ndarray:
        """Regression values (texts x languages) of texts given by their different runs."""
        out = np.zeros((len(rows), len(self.languages)))
        if len(self.codes) == 0:
            return out
        for begin in range(0, len(rows), BLOCK_TEXTS):
            own = rows[begin : begin + BLOCK_TEXTS]
            sizes = np.array([len(r) for r in own], np.int64)
            at, known = _places(self.codes, np.concatenate(own))
            touched, column = np.unique(at[known], return_inverse=True)
            presence = np.zeros((len(own), len(touched)))
            presence[np.repeat(np.arange(len(own)), sizes)[known], column] = 1.0
            out[begin : begin + BLOCK_TEXTS] = presence @ self.table[touched] / np.sqrt(np.maximum(sizes, 1))[:, None]
        return out


def in_fold(doc_id: Column, cfg: LanguageConfig) -> Column:
    """Whether a row is held out; null ids count as the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % cfg.folds == cfg.held_out


def training_sample(docs: DataFrame, cfg: LanguageConfig) -> DataFrame:
    """Stored (lang, text, h): at most `train_texts` different texts of each language."""
    usable = docs.filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), cfg)
        & F.col("text").rlike(r"\p{L}")
    ).select("lang", "text", F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    # the texts stay where they are until it is known which are wanted
    narrow = usable.select("lang", "h", F.xxhash64("text").alias("t")).groupBy("lang", "t").agg(F.min("h").alias("h"))
    first = top_per_group(narrow, "lang", [F.col("h"), F.col("t")], cfg.train_texts, spread_on="t")
    cut = F.broadcast(first.groupBy("lang").agg(F.max("h").alias("last")))
    chosen = usable.join(cut, "lang").filter(F.col("h") <= F.col("last"))
    texts = chosen.groupBy("lang", "text").agg(F.min("h").alias("h"))
    return stored(texts, "language-sample")


def fit_languages(docs: DataFrame, cfg: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """Fit on the training folds of `docs` (doc_id, text, lang)."""
    small_batches(docs.sparkSession)
    sample = training_sample(docs, cfg)
    languages = tuple(sorted(r["lang"] for r in sample.select("lang").distinct().collect()))
    short = sample.filter(F.length("text") <= cfg.landmark_signs)
    marks = top_per_group(short, "lang", [F.col("h"), F.col("text")], cfg.landmarks, spread_on="h")
    rows = sorted((r["lang"], r["h"], r["text"]) for r in marks.select("lang", "h", "text").collect())
    seen = [runs(text, cfg.longest_run) for _, _, text in rows]
    if not seen:
        return LanguageModel(languages, np.zeros(0, np.int64), np.zeros((0, len(languages))), cfg)
    codes = _distinct(np.concatenate(seen))
    # a column of the 0/1 matrix for each landmark, over the root of its number of runs
    matrix = np.zeros((len(codes), len(seen)), np.float32)
    for j, own in enumerate(seen):
        matrix[np.searchsorted(codes, own), j] = 1.0 / np.sqrt(len(own))
    kernel = matrix.T.astype(float) @ matrix
    values, turn = np.linalg.eigh(kernel)
    strong = values > 1e-10 * values[-1]
    half = turn[:, strong] / np.sqrt(values[strong])
    gram, right = _normal_equations(sample, languages, codes, matrix, half, cfg)
    weights = np.linalg.solve(gram + cfg.ridge * np.trace(gram) / len(gram) * np.eye(len(gram)), right)
    return LanguageModel(languages, codes, matrix @ (half @ weights), cfg)


def _normal_equations(sample, languages, codes, matrix, half, cfg) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the sample of f f' and f y', f the Nystroem vector of a text and y its +1/-1 row.

    Each language weighs the same, however many texts it has.
    """
    width, m = half.shape[1], len(languages)
    counts = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = np.array([1.0 / counts[name] for name in languages])
    shipped = sample.sparkSession.sparkContext.broadcast((codes, matrix, half))
    number = {name: i for i, name in enumerate(languages)}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, matrix, half = shipped.value
        total = np.zeros((width, width + m))
        for batch in batches:
            own = [runs(text, cfg.longest_run, cfg.stretch) for text in batch.column(1).to_pylist()]
            kernel = np.zeros((len(own), matrix.shape[1]))
            for i, row in enumerate(own):
                at, known = _places(codes, row)
                kernel[i] = matrix[at[known]].sum(axis=0) / np.sqrt(max(len(row), 1))
            f = kernel @ half
            label = np.array([number[name] for name in batch.column(0).to_pylist()], np.int64)
            y = np.where(label[:, None] == np.arange(m), 1.0, -1.0)
            weighed = f * share[label][:, None]
            total += weighed.T @ np.hstack([f, y])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(i.ravel().astype(np.int32)), "j": pa.array(j.ravel().astype(np.int32)),
            "v": pa.array(total.ravel()),
        })

    cells = sample.select("lang", "text").mapInArrow(partial, "i int, j int, v double")
    out = np.zeros((width, width + m))
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    shipped.unpersist()
    return out[:, :width], out[:, width:]


def language_of(model: LanguageModel, text: Column, shipped=None) -> Column:
    """struct(lang_pred, score) of a text column; the score is the regression value moved from
    -1..1 to 0..1 and cut there."""
    names = np.array([*model.languages, UNKNOWN], object)
    cfg = model.cfg

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        known = model if shipped is None else shipped.value
        rows = [runs(text or "", cfg.longest_run, cfg.stretch) for text in texts.to_pylist()]
        blank = np.array([len(r) == 0 for r in rows], bool) | (len(known.languages) == 0)
        best = np.full(len(rows), len(known.languages))
        score = np.zeros(len(rows))
        if len(known.languages):
            value = known.decide(rows)
            best = np.where(blank, best, value.argmax(axis=1))
            score = np.where(blank, 0.0, np.clip((value.max(axis=1) + 1) / 2, 0.0, 1.0))
        return pa.StructArray.from_arrays(
            [pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["lang_pred", "score"]
        )

    return predict(text)


def identify_languages(docs: DataFrame, cfg: LanguageConfig = LanguageConfig()) -> DataFrame:
    """(row, held_out, lang_pred, score) of every document, learned from its own training folds."""
    model = fit_languages(docs, cfg)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    found = docs.select(
        row_of(docs).alias("row"), in_fold(F.col("doc_id"), cfg).alias("held_out"),
        language_of(model, F.col("text"), shipped).alias("m"),
    )
    return found.select("row", "held_out", "m.lang_pred", "m.score")
