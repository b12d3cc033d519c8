"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are scaled to length one, where a cosine is a distance. Each table hashes a vector by
several Gaussian projections, shifted and cut into steps; vectors whose steps all agree share a
bucket, and only those are compared, by their exact cosine. (Datar et al., 2004.)
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyrank.llm.common import component_labels, small_batches
from storyrank.sources.scratch import stored

X_BITS, A_BITS = 20, 16


@dataclass(frozen=True)
class PStableConfig:
    """`miss`: chance that a pair exactly at the threshold meets in no table. The number of
    projections and tables follows from it, the step and the number of vectors. Buckets of more
    than `bucket_rows` vectors are compared part against part, so that none is lost."""

    threshold: float = 0.95
    step: float = 2.0
    miss: float = 0.01
    seed: int = 42
    bucket_rows: int = 4_096
    pair_rows: int = 48
    hold_rows: int = 32_768

    def collision(self, distance: float) -> float:
        """Chance that one projection puts two vectors at this distance into the same step."""
        r = self.step / distance
        tail = 2 * math.sqrt(1 / (2 * math.pi)) / r * (1 - math.exp(-r * r / 2))
        return math.erf(r / math.sqrt(2)) - tail

    def shape(self, n: int) -> tuple[int, int]:
        """Projections of a table and tables: an unrelated pair meets in few of n buckets."""
        near = self.collision(math.sqrt(max(2 - 2 * self.threshold, 1e-12)))
        far = self.collision(math.sqrt(2))
        width = max(1, math.ceil(math.log(max(n, 2)) / -math.log(far)))
        return width, math.ceil(math.log(self.miss) / math.log(1 - near**width))


class Hashes:
    """Bucket keys of unit vectors. Projections use whole numbers, whose sums are exact in any
    order, so that a vector has the same keys wherever they are computed."""

    def __init__(self, dims: int, width: int, tables: int, cfg: PStableConfig) -> None:
        random = np.random.default_rng([cfg.seed, dims])
        self.width, self.tables = width, tables
        self.normals = np.rint(random.standard_normal((dims, tables * width)) * 2**A_BITS)
        unit = cfg.step * 2.0 ** (X_BITS + A_BITS)
        self.shift, self.unit = np.rint(random.random(tables * width) * unit), np.rint(unit)
        self.mix = random.integers(1, 2**62, width, np.int64) * 2 + 1

    def keys(self, unit_rows: np.ndarray) -> np.ndarray:
        """(rows, tables) keys."""
        projected = np.rint(unit_rows * 2**X_BITS) @ self.normals
        steps = np.floor((projected + self.shift) / self.unit).astype(np.int64)
        return (steps.reshape(len(unit_rows), self.tables, self.width) * self.mix).sum(axis=2)


_HASHES: dict[tuple, Hashes] = {}


def _hashes(dims: int, width: int, tables: int, cfg: PStableConfig) -> Hashes:
    key = (dims, width, tables, cfg.step, cfg.seed)
    if key not in _HASHES:
        _HASHES[key] = Hashes(*key[:3], cfg)
    return _HASHES[key]


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    # scaled by the largest component first, so that squares neither overflow nor vanish
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _valid(values: list | None) -> np.ndarray | None:
    """The vector, or None when it is null, empty, zero or has null or non-finite components."""
    if not values or any(v is None for v in values):
        return None
    row = np.array(values, np.float64)
    return row if np.isfinite(row).all() and row.any() else None


# ------------------------------------------------------------------------- into buckets


def _read(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    """(id, uid, dims, vec) with vec as bytes, null where it links with nothing."""
    uid = TaskContext.get().partitionId() << 33
    for batch in batches:
        rows = [_valid(v) for v in batch.column(1).to_pylist()]
        uids = pa.array(range(uid, uid + len(rows)), pa.int64())
        uid += len(rows)
        dims = pa.array([None if r is None else len(r) for r in rows], pa.int32())
        vecs = pa.array([None if r is None else r.astype(dtype).tobytes() for r in rows], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), uids, dims, vecs], ["id", "uid", "dims", "vec"])


def _by_dims(dims: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for d in np.unique(dims):
        yield int(d), np.flatnonzero(dims == d)


def _keyed(
    batches: Iterator[pa.RecordBatch], shape: tuple[int, int], dtype: str, cfg: PStableConfig
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column(1).to_numpy()
        for d, at in _by_dims(dims):
            part = batch.take(pa.array(at))
            rows = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype).reshape(-1, d)
            keys = _hashes(d, *shape, cfg).keys(_unit(rows))
            for t in range(shape[1]):
                # the table and the length are part of the key
                own = keys[:, t] * 1_000_003 + (t * 65_537 + d)
                columns = [pa.array(own), pa.array(np.full(len(at), t, np.int32)), *part.columns]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "t", "uid", "dims", "vec"])


# ------------------------------------------------------------------------ compare buckets


class _Found:
    """Links found among the rows in hand: numbers of first meetings, and who hangs together."""

    def __init__(self, n: int) -> None:
        self.links = np.zeros(n, np.int64)
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray, first: np.ndarray) -> None:
        np.add.at(self.links, i[first], 1)
        np.add.at(self.links, j[first], 1)
        while len(i):
            a, b = self.label[i], self.label[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            least = np.minimum(a, b)
            np.minimum.at(self.label, a, least)
            np.minimum.at(self.label, b, least)
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def _compare(
    bucket: np.ndarray, table: np.ndarray, side: np.ndarray, rows: np.ndarray,
    shape: tuple[int, int], cfg: PStableConfig,
) -> _Found:
    """Links within runs of equal bucket; `side` 0 and 1 are compared across only, 2 all."""
    n, found = len(rows), _Found(len(rows))
    units, hashes = _unit(rows), _hashes(rows.shape[1], *shape, cfg)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, n])

    def check(i: np.ndarray, j: np.ndarray) -> None:
        """Pairs whose cosine passes; counts those that met in no earlier table."""
        if not len(i):
            return
        own, at = np.unique(np.r_[i, j], return_inverse=True)
        keys = hashes.keys(units[own])
        met = keys[at[: len(i)]] == keys[at[len(i) :]]
        found.add(i, j, met.argmax(axis=1) == table[i])

    def crossing(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (side[i] == 2) | (side[i] != side[j])

    # small buckets: row with the row `gap` later, for all of them at once
    place = np.arange(n) - np.repeat(starts, sizes)
    size_of = np.repeat(sizes, sizes)
    small = (size_of > 1) & (size_of <= cfg.pair_rows)
    for gap in range(1, cfg.pair_rows):
        i = np.flatnonzero(small & (place + gap < size_of))
        if not len(i):
            break
        near = np.einsum("ij,ij->i", units[i], units[i + gap]) >= cfg.threshold
        i = i[near & crossing(i, i + gap)]
        check(i, i + gap)
    # larger ones: blocks of a matrix product
    for start, size in zip(starts[sizes > cfg.pair_rows], sizes[sizes > cfg.pair_rows]):
        stop = start + size
        for a in range(start, stop, 256):
            b = min(a + 256, stop)
            i, j = np.nonzero(units[a:b] @ units[a:stop].T >= cfg.threshold)
            later = j > i
            i, j = i[later] + a, j[later] + a
            keep = crossing(i, j)
            i, j = i[keep], j[keep]
            for begin in range(0, len(i), 65_536):
                check(i[begin : begin + 65_536], j[begin : begin + 65_536])
    return found


def _links(
    batches: Iterator[pa.RecordBatch], shape: tuple[int, int], dtype: str, cfg: PStableConfig
) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, t, uid, dims, vec, side) sorted by bucket, to (uid, links, root)."""

    def compared(whole: pa.Table) -> Iterator[pa.RecordBatch]:
        for d, at in _by_dims(whole.column("dims").to_numpy()):
            part = whole.take(pa.array(at))
            rows = np.frombuffer(b"".join(part.column("vec").to_pylist()), dtype).reshape(-1, d)
            names = ("bucket", "t", "side", "uid")
            bucket, table, side, uid = (part.column(c).to_numpy() for c in names)
            found = _compare(bucket, table, side, rows, shape, cfg)
            linked = np.isin(np.arange(len(uid)), found.label[found.label != np.arange(len(uid))])
            linked |= found.label != np.arange(len(uid))
            linked = np.flatnonzero(linked)
            columns = [uid[linked], found.links[linked], uid[found.label[linked]]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["uid", "links", "root"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= cfg.hold_rows:
            whole = pa.Table.from_batches(held)
            buckets = whole.column("bucket").to_numpy()
            cut = int(np.searchsorted(buckets, buckets[-1]))
            yield from compared(whole.slice(0, cut))
            held = whole.slice(cut).combine_chunks().to_batches()
            rows -= cut
    if held:
        yield from compared(pa.Table.from_batches(held))


# ------------------------------------------------------------------------------ operator


def embedding_links(
    df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", cfg: PStableConfig = PStableConfig()
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Vectors of the same length link when their cosine is at least the threshold. A vector that is
    null, empty, zero, or holds null or non-finite components links with nothing. Repeated rows are
    vectors of their own. component_id is the smallest id that links reach (null only where all
    are null). Other columns are not read; an empty table gives an empty result.
    """
    spark = df.sparkSession
    small_batches(spark)
    vectors = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"))
    kind = vectors.schema["id"].dataType.simpleString()
    dtype = "<f4" if vectors.schema["vec"].dataType.elementType.typeName() == "float" else "<f8"
    read = stored(
        vectors.mapInArrow(lambda b: _read(b, dtype), f"id {kind}, uid long, dims int, vec binary"), "vectors"
    )
    valid = read.filter(F.col("vec").isNotNull()).select("uid", "dims", "vec")
    shape = cfg.shape(valid.count())
    keyed = valid.mapInArrow(
        lambda b: _keyed(b, shape, dtype, cfg), "bucket long, t int, uid long, dims int, vec binary"
    )
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n"))
    # fewer than (vectors x tables / bucket_rows) buckets are as large as this
    large = stored(sizes.filter(F.col("n") > cfg.bucket_rows), "large-buckets")
    parts = F.coalesce(F.ceil(F.col("n") / cfg.bucket_rows), F.lit(1)).cast("int")
    dealt = (
        keyed.join(large, "bucket", "left")
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts").cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            F.when(F.col("parts") == 1, F.col("bucket"))
            .otherwise(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")))
            .alias("bucket"),
            "t", "uid", "dims", "vec",
            F.when(F.col("part") == F.col("other"), 2)
            .otherwise((F.col("part") > F.col("other")).cast("int")).alias("side"),
        )
    )
    links = stored(
        dealt.repartition("bucket").sortWithinPartitions("bucket", "dims")
        .mapInArrow(lambda b: _links(b, shape, dtype, cfg), "uid long, links long, root long"),
        "vector-links",
    )
    counts = links.groupBy("uid").agg(F.sum("links").alias("n_links"))
    labels = component_labels(links.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    members = stored(
        read.select("id", "uid")
        .join(counts, "uid", "left")
        .join(labels.withColumnRenamed("node", "uid"), "uid", "left"),
        "vector-members",
    )
    least = (
        members.filter(F.col("component").isNotNull())
        .groupBy("component").agg(F.min("id").alias("least"))
    )
    component = F.coalesce("least", "id")
    return members.join(least, "component", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
