"""Nearest vectors of many queries: blocked products with a bounded list per query.

Rows and queries are dealt to lanes, one for each block of queries and slice of the rows. A lane holds
its block of queries and the best rows so far of each of them, and multiplies it with its rows chunk
by chunk, so it needs the same memory however many rows pass. The lists of the slices meet in a
ranking that keeps the best of each task before its shuffle. Nothing comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyrank.operators.topk import top_per_group
from storyrank.sources.scratch import stored


@dataclass(frozen=True)
class NearestConfig:
    """`block_bytes` of query vectors lie in a task; `tile_cells` similarities are looked at together."""

    block_bytes: int = 64 * 1024 * 1024
    tile_cells: int = 1 << 21
    digits: int = 9


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int,
    key: str = "word",
    column: str = "vector",
    cfg: NearestConfig = NearestConfig(),
) -> DataFrame:
    """(example, rank, <key>, similarity): the `k` rows nearest by cosine to each query, itself included.

    Both tables have a `key` of the same type, unique in each, and an array `column`. Similarities
    count after rounding to `digits`, ties fall to the smaller key. A null, empty or zero vector and
    one with null or non-finite entries has no neighbours and is none; vectors of different lengths
    are not compared.
    """
    found = [c.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("v")) for c in (rows, queries)]
    filled = [c.filter(F.col("v").isNotNull() & F.col("key").isNotNull() & (F.size("v") > 0)) for c in found]
    wanted = stored(filled[1], "nearest-queries")
    entries = wanted.agg(F.sum(F.size("v"))).first()[0] or 0
    blocks = max(-(-8 * entries // cfg.block_bytes), 1)
    slices = max(rows.sparkSession.sparkContext.defaultParallelism // blocks, 1)

    def number(name: str, n: int):
        return F.pmod(F.xxhash64("key", F.lit(name)), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    lane = (F.col("block") * slices + F.col("slice")).alias("lane")
    asked = wanted.select("*", number("block", blocks).alias("block"), every(slices).alias("slice"))
    given = filled[0].select("*", number("slice", slices).alias("slice"), every(blocks).alias("block"))
    met = (
        asked.select(lane, F.lit(0).alias("kind"), "key", "v")
        .unionByName(given.select(lane, F.lit(1).alias("kind"), "key", "v"))
        .repartitionById(blocks * slices, F.col("lane"))
        .sortWithinPartitions("lane", "kind")
    )
    kind = dict(found[0].dtypes)["key"]
    best = met.mapInArrow(_lists(k, cfg), f"example {kind}, key {kind}, similarity double")
    order = [F.col("similarity").desc(), F.col("key")]
    ranked = top_per_group(best, "example", order, k)
    return ranked.select("example", "rank", F.col("key").alias(key), "similarity")


def _lists(k: int, cfg: NearestConfig):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, block = None, _Block(k, cfg)
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in (0, 1)])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if marks[0, begin] != lane:
                    yield from block.results(batch.schema.field("key").type)
                    lane, block = marks[0, begin], _Block(k, cfg)
                part = batch.slice(begin, end - begin)
                (block.ask if marks[1, begin] == 0 else block.meet)(part.column(2), part.column(3))
        if lane is not None:
            yield from block.results(batch.schema.field("key").type)

    return search


class _Block:
    """The queries of one lane, by length of their vectors, with the best rows seen."""

    def __init__(self, k: int, cfg: NearestConfig) -> None:
        self.k, self.cfg = k, cfg
        self.asked: dict[int, list] = {}
        self.ready: dict[int, _Best] = {}

    def ask(self, keys: pa.Array, vectors: pa.Array) -> None:
        for width, own, units in _units(keys, vectors):
            self.asked.setdefault(width, []).append((own, units))

    def meet(self, keys: pa.Array, vectors: pa.Array) -> None:
        for width, own, units in _units(keys, vectors):
            if width in self.asked:
                if width not in self.ready:
                    names, parts = zip(*self.asked[width])
                    self.ready[width] = _Best(np.concatenate(names), np.concatenate(parts), self.k, self.cfg)
                self.ready[width].meet(own, units)

    def results(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for best in self.ready.values():
            yield from best.results(kind)


class _Best:
    def __init__(self, names: np.ndarray, units: np.ndarray, k: int, cfg: NearestConfig) -> None:
        self.names, self.units, self.k, self.cfg = names, units, k, cfg
        # flat lists, ordered by query, then by falling similarity, then by key
        self.query = np.zeros(0, np.int64)
        self.value = np.zeros(0)
        self.key = np.zeros(0, names.dtype)
        # the worst similarity that still counts, and the key it came with
        self.least = np.full(len(names), -np.inf)
        self.last = np.zeros(len(names), names.dtype)

    def meet(self, keys: np.ndarray, units: np.ndarray) -> None:
        step = max(self.cfg.tile_cells // max(len(self.names), 1), 1)
        for begin in range(0, len(keys), step):
            self._tile(keys[begin : begin + step], units[begin : begin + step])

    def _tile(self, keys: np.ndarray, units: np.ndarray) -> None:
        tile = np.round(self.units @ units.T, self.cfg.digits)
        least = self.least
        if tile.shape[1] > self.k:
            # what is below the k-th of the tile itself cannot stay either
            least = np.maximum(least, np.partition(tile, -self.k, axis=1)[:, -self.k])
        query, column = np.nonzero(tile >= least[:, None])
        value, key = tile[query, column], keys[column]
        stays = (value > self.least[query]) | (key < self.last[query])
        if not stays.any():
            return
        query = np.concatenate([self.query, query[stays]])
        value = np.concatenate([self.value, value[stays]])
        key = np.concatenate([self.key, key[stays]])
        order = np.lexsort((key, -value, query))
        query, value, key = query[order], value[order], key[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        self.query, self.value, self.key = query[kept], value[kept], key[kept]
        full = np.flatnonzero(rank[kept] == self.k - 1)
        self.least[self.query[full]] = self.value[full]
        self.last[self.query[full]] = self.key[full]

    def results(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for begin in range(0, len(self.query), 10_000):
            own = slice(begin, begin + 10_000)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(self.names[self.query[own]].tolist(), kind),
                    pa.array(self.key[own].tolist(), kind), pa.array(self.value[own]),
                ],
                ["example", "key", "similarity"],
            )


def _units(keys: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, keys, unit vectors) of the usable rows of a batch, by length."""
    sizes = pc.list_value_length(vectors).to_numpy()
    names = keys.to_numpy(zero_copy_only=False)
    if names.dtype == object:
        names = names.astype(np.dtypes.StringDType())
    for width in np.unique(sizes):
        at = np.flatnonzero(sizes == width)
        rows = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), width)
        with np.errstate(invalid="ignore"):
            largest = np.abs(rows).max(axis=1, initial=0.0)
            good = np.isfinite(largest) & (largest > 0)
            rows = rows[good] / largest[good][:, None]
        yield int(width), names[at[good]], rows / np.linalg.norm(rows, axis=1, keepdims=True)
