"""Whitening of embeddings from an incrementally kept eigendecomposition.

Each task keeps (count, mean, spectrum) of the scatter of its rows. A row that joins moves the
scatter by one centred outer product, and the spectrum follows by solving the secular equation
1 + sum z_i^2 / (d_i - x) = 0, after entries without weight and equal eigenvalues were deflated
(Bunch, Nielsen and Sorensen, 1978; vectors from recomputed weights as in Gu and Eisenstat, 1994).
A batch with more rows than dimensions is first turned into as many rows as dimensions with the
same scatter (the triangular factor of the centred batch), so a row costs little. Two spectra
combine by one update for each eigenvector of one of them and one for the distance of the means;
states meet in a tree of tasks. What remains of rounding goes with one more pass: Rayleigh-Ritz on
the found basis, whose small matrix is summed over all rows.

Entries c become whole numbers x = floor(64 c) + 1000000 and everything is fitted to these.

Rows: a vector that is null, or holds null or non-finite entries, is dropped, and so is one whose
length is not that of most vectors (the longer at a tie) or whose entries pass 2^53 / 64 in size.
Repeated rows and equal vectors count each time. Columns of the input travel in the struct `row`.
Eigenvalues that are zero to working precision (fewer distinct vectors than dimensions, a single
row) give components with whitened value 0, which the identity error leaves out. A deviation that
no long can hold is null. Equal eigenvalues: any orthonormal choice, the same for all rows. An
empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyrank.llm.common import row_of
from storyrank.sources.scratch import stored

STEPS, SHIFT = 64, 1_000_000
LARGEST = 2.0**53
EPS = np.finfo(float).eps
# eigenvalues below this part of the largest count as zero
ZERO = 1e-12
# rows that join a spectrum together
TOGETHER = 8_192


@dataclass(frozen=True)
class WhitenConfig:
    components: int = 32
    # states that one task combines
    fan: int = 8


@dataclass(frozen=True)
class Whitening:
    """A fit: `sums` are exact per dimension, `basis` has a column per component, by falling value."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    basis: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        """Mean of x - SHIFT, rounded once."""
        return np.array([(s - SHIFT * self.n) / self.n for s in self.sums])

    @property
    def scaled(self) -> np.ndarray:
        """The basis over the root of its eigenvalues; zero where these are."""
        strong = self.values > ZERO * max(self.values[0], 1e-300)
        return self.basis * np.where(strong, 1.0 / np.sqrt(np.where(strong, self.values, 1.0)), 0.0)


# ------------------------------------------------------------------ updates of a spectrum


def rank_one(values: np.ndarray, vectors: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (ascending) of `vectors diag(values) vectors' + u u'`."""
    z = vectors.T @ u
    size = np.sqrt(z @ z)
    if size == 0.0:
        return values, vectors
    tol = 8 * EPS * max(values[-1], size * size)
    z = np.where(np.abs(z) * size > tol, z, 0.0)
    kept = np.flatnonzero(z)
    if len(kept) > 1 and np.any(_closeness(values, z, kept) <= tol):
        values, vectors, z = _merge_equal(values, vectors, z, kept, tol)
        kept = np.flatnonzero(z)
    if len(kept) == 0:
        return values, vectors
    order = kept[np.argsort(values[kept], kind="stable")]
    roots, turn = _secular(values[order], z[order])
    values, moved = values.copy(), vectors.copy()
    values[order] = roots
    moved[:, order] = vectors[:, order] @ turn
    rising = np.argsort(values, kind="stable")
    return values[rising], moved[:, rising]


def _closeness(values: np.ndarray, z: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Entry that a rotation of two neighbours, which empties one weight, would leave beside them."""
    a, b = z[kept[:-1]], z[kept[1:]]
    return (values[kept[1:]] - values[kept[:-1]]) * np.abs(a * b) / (a * a + b * b)


def _merge_equal(values, vectors, z, kept, tol):
    """Rotate eigenvectors of (almost) equal eigenvalues until one of them carries the weight."""
    values, vectors, z = values.copy(), vectors.copy(), z.copy()
    last = kept[0]
    for j in kept[1:]:
        r = np.hypot(z[last], z[j])
        c, s = z[j] / r, z[last] / r
        if (values[j] - values[last]) * abs(c * s) <= tol:
            a, b = vectors[:, last].copy(), vectors[:, j].copy()
            vectors[:, last], vectors[:, j] = c * a - s * b, s * a + c * b
            z[last], z[j] = 0.0, r
            low, high = values[last], values[j]
            values[last], values[j] = c * c * low + s * s * high, s * s * low + c * c * high
        last = j
    return values, vectors, z


def _secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(d) + z z', d rising without ties, z without zeros.

    All roots are found at once, each as its distance from the nearer pole: the parts of the sum
    left and right of a root are replaced by simple fractions with their value and slope, which
    gives a quadratic; a step that leaves the bracket halves it instead.
    """
    k, w = len(d), z * z
    total = w.sum()
    if k == 1:
        return d + w, np.ones((1, 1))
    gap = np.append(np.diff(d), total)
    own, above = np.arange(k), np.minimum(np.arange(k) + 1, k - 1)
    middle = d + gap / 2
    left = (1.0 + (w[:, None] / (d[:, None] - middle)).sum(axis=0)) > 0
    left[-1] = True
    origin = np.where(left, d, d[above])
    low = np.where(left, 0.0, -gap / 2)
    high = np.where(left, gap / 2, 0.0)
    high[-1] = total * (1 + 4 * EPS)
    delta = d[:, None] - origin
    lower = own[:, None] <= own
    x = (low + high) / 2
    with np.errstate(all="ignore"):
        for _ in range(60):
            e = delta - x
            part = w[:, None] / e
            slope = part / e
            psi, phi = np.where(lower, part, 0.0).sum(axis=0), np.where(lower, 0.0, part).sum(axis=0)
            dpsi, dphi = np.where(lower, slope, 0.0).sum(axis=0), np.where(lower, 0.0, slope).sum(axis=0)
            f = 1.0 + psi + phi
            low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
            a, b = e[own, own], e[above, own]
            rest = 1.0 + psi - dpsi * a + phi - dphi * b
            half = rest * (a + b) + dpsi * a * a + dphi * b * b
            flat = a * b * f
            root = np.sqrt(np.maximum(half * half - 4 * rest * flat, 0.0))
            step = np.where(half <= 0, (half - root) / (2 * rest), 2 * flat / (half + root))
            step[-1] = a[-1] + dpsi[-1] * a[-1] * a[-1] / (1.0 + psi[-1] - dpsi[-1] * a[-1])
            new = x + step
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
            done = (np.abs(f) <= 4 * EPS * (1.0 + np.abs(part).sum(axis=0))) | (high - low <= EPS * np.abs(x))
            x = np.where(done, x, new)
            if done.all():
                break
    e = delta - x
    below = own[:, None] > own
    poles = d[:, None] - np.where(below, d, d[above])
    poles[:, -1] = -1.0
    weight = np.sqrt(np.abs(np.prod(e / poles, axis=1)))
    turn = np.where(z < 0, -weight, weight)[:, None] / e
    return origin + x, turn / np.linalg.norm(turn, axis=0)


class Spectrum:
    """Count, exact sums, mean and eigendecomposition of the scatter of the rows seen."""

    def __init__(self, dims: int) -> None:
        self.n, self.sums, self.mean = 0, [0] * dims, np.zeros(dims)
        self.values, self.vectors = np.zeros(dims), np.eye(dims)

    def add(self, x: np.ndarray) -> None:
        """Rows of whole numbers."""
        n, dims = x.shape
        if n == 0:
            return
        y = (x - SHIFT).astype(float)
        mean = y.mean(axis=0)
        centred = y - mean
        if n > dims:
            centred = np.linalg.qr(centred, mode="r")
        self._join(n, exact_sums(x), mean, centred)

    def combine(self, other: Spectrum) -> None:
        if other.n:
            self._join(other.n, other.sums, other.mean, (other.vectors * np.sqrt(np.maximum(other.values, 0.0))).T)

    def packed(self, slot: int) -> pa.RecordBatch:
        payload = pickle.dumps((self.n, self.sums, self.mean, self.values, self.vectors))
        return pa.RecordBatch.from_pydict(
            {"slot": pa.array([slot], pa.int64()), "payload": pa.array([payload], pa.binary())}
        )

    @staticmethod
    def unpacked(payload: bytes) -> Spectrum:
        parts = pickle.loads(payload)
        state = Spectrum(len(parts[1]))
        state.n, state.sums, state.mean, state.values, state.vectors = parts
        return state

    def _join(self, n: int, sums: list[int], mean: np.ndarray, directions: np.ndarray) -> None:
        apart = (mean - self.mean) * np.sqrt(self.n * (n / (self.n + n)))
        for u in (*directions, apart):
            self.values, self.vectors = rank_one(self.values, self.vectors, u)
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n
        self.sums = [a + b for a, b in zip(self.sums, sums)]


def exact_sums(x: np.ndarray) -> list[int]:
    if len(x) * float(np.abs(x).max(initial=0)) < 2.0**62:
        return [int(s) for s in x.sum(axis=0)]
    return [sum(map(int, column)) for column in x.T]


# ------------------------------------------------------------------------- passes


def whole_rows(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, whole numbers) of the usable vectors of an Arrow batch."""
    fits = np.flatnonzero(pc.fill_null(pc.list_value_length(vectors), -1).to_numpy() == dims)
    flat = vectors.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
    scaled = STEPS * flat.astype(float).reshape(len(fits), dims)
    with np.errstate(invalid="ignore"):
        good = (np.isfinite(scaled) & (np.abs(scaled) < LARGEST)).all(axis=1)
    return fits[good], np.floor(scaled[good]).astype(np.int64) + SHIFT


def _dims(df: DataFrame, column: str) -> int:
    sizes = df.filter(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.col("n").desc(), F.col("d").desc()).first()
    return first["d"] if first else 0


def fit_spectrum(df: DataFrame, column: str, dims: int, cfg: WhitenConfig = WhitenConfig()) -> Spectrum:
    """One spectrum of all rows; the driver sees only the last state."""

    def of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Spectrum(dims)
        waiting: list[np.ndarray] = []
        for batch in batches:
            waiting.append(whole_rows(batch.column(0), dims)[1])
            if sum(map(len, waiting)) >= TOGETHER:
                state.add(np.concatenate(waiting))
                waiting = []
        if waiting:
            state.add(np.concatenate(waiting))
        if state.n:
            yield state.packed(TaskContext.get().partitionId())

    def of_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        if rows:
            rows.sort()
            state = Spectrum.unpacked(rows[0][1])
            for _, payload in rows[1:]:
                state.combine(Spectrum.unpacked(payload))
            yield state.packed(rows[0][0])

    schema = "slot long, payload binary"
    states = stored(df.select(column).mapInArrow(of_part, schema), "whitening-states")
    left = states.count()
    while left > 1:
        parts = -(-left // cfg.fan)
        met = states.withColumn("met", F.pmod(F.xxhash64("slot"), F.lit(parts))).repartition(parts, "met")
        states = stored(met.select("slot", "payload").mapInArrow(of_states, schema), "whitening-states")
        left = states.count()
    last = states.first()
    return Spectrum.unpacked(last["payload"]) if last else Spectrum(dims)


def _moments(df: DataFrame, column: str, dims: int, mean: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """Covariance of the rows in the coordinates of `basis`, summed over all rows."""
    width = basis.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width + 1, width))
        for batch in batches:
            y = ((whole_rows(batch.column(0), dims)[1] - SHIFT) - mean) @ basis
            gram[:width] += y.T @ y
            gram[width] += y.sum(axis=0)
        rows, columns = np.indices(gram.shape)
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(rows.ravel().astype(np.int32)), "j": pa.array(columns.ravel().astype(np.int32)),
            "v": pa.array(gram.ravel()),
        })

    cells = df.select(column).mapInArrow(partial, "i int, j int, v double")
    out = np.zeros((width + 1, width))
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    out /= n
    return out[:width] - np.outer(out[width], out[width])


def fit_whitening(df: DataFrame, column: str = "embedding", cfg: WhitenConfig = WhitenConfig()) -> Whitening | None:
    """Fit on all usable rows; None when there are none."""
    dims = _dims(df, column)
    state = fit_spectrum(df, column, dims, cfg) if dims else None
    if state is None or state.n == 0:
        return None
    found = Whitening(state.n, tuple(state.sums), state.values[::-1], np.linalg.qr(state.vectors[:, ::-1])[0], 1.0)
    small = _moments(df, column, dims, found.mean, found.basis, found.n)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    basis = (found.basis @ turn)[:, ::-1]
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(dims)] < 0, -1.0, 1.0)
    kept = min(cfg.components, dims)
    found = Whitening(
        found.n, found.sums, np.maximum(values[::-1], 0.0)[:kept], basis[:, :kept], float(np.trace(small))
    )
    scaled = found.scaled
    strong = np.flatnonzero(scaled.any(axis=0))
    error = 0.0
    if len(strong):
        white = _moments(df, column, dims, found.mean, scaled[:, strong], found.n)
        error = float(np.abs(white - np.eye(len(strong))).max())
    return Whitening(found.n, found.sums, found.values, found.basis, found.trace, error)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n x - S)^2."""
    largest = float(np.abs(x).max(initial=0))
    if n * largest < 2.0**61:
        apart = n * x - sums.astype(np.int64)
        if x.shape[1] * float(np.abs(apart).max(initial=0)) ** 2 < 2.0**62:
            return (apart * apart).sum(axis=1).tolist()
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return [e if e < 2**63 else None for e in exact]


def whitened(found: Whitening, column: Column) -> Column:
    """struct(deviation, whitened array) of a vector column; null for vectors that are dropped."""
    mean, scaled, n = found.mean, found.scaled, found.n
    sums, dims = np.array(found.sums, object), len(found.sums)

    @F.arrow_udf("struct<deviation:long,whitened:array<double>>")
    def apply(vectors: pa.Array) -> pa.Array:
        at, x = whole_rows(vectors, dims)
        flat = (((x - SHIFT) - mean) @ scaled).ravel()
        place = np.full(len(vectors), -1, np.int64)
        place[at] = np.arange(len(at))
        rows = pa.ListArray.from_arrays(
            pa.array(np.arange(len(at) + 1, dtype=np.int32) * scaled.shape[1]), pa.array(flat)
        )
        made = pa.StructArray.from_arrays(
            [pa.array(_deviations(x, n, sums), pa.int64()), rows], ["deviation", "whitened"]
        )
        return made.take(pa.array(place, mask=place < 0))

    # so that a filter on the result does not make it twice
    return apply.asNondeterministic()(column)


def whiten(df: DataFrame, column: str = "embedding", cfg: WhitenConfig = WhitenConfig()) -> DataFrame:
    """(row, n, deviation, whitened, explained, identity_error) of each usable row; arrays hold the
    components by falling eigenvalue."""
    found = fit_whitening(df, column, cfg)
    if found is None:
        kinds = {"n": "long", "deviation": "long", "whitened": "array<double>", "explained": "array<double>",
                 "identity_error": "double"}
        blank = [F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]
        return df.select(row_of(df).alias("row"), *blank).limit(0)
    trace = found.trace if found.trace > 0 else 1.0
    shares = F.array(*[F.lit(float(v)) for v in found.values / trace])
    made = df.select(row_of(df).alias("row"), whitened(found, F.col(column)).alias("m"))
    return made.filter(F.col("m").isNotNull()).select(
        "row", F.lit(found.n).cast("long").alias("n"), "m.deviation", "m.whitened",
        shares.alias("explained"), F.lit(found.identity_error).alias("identity_error"),
    )
