"""Counts of word pairs as packed whole numbers, and sums over a square matrix made of them.

A pair of numbered words is one whole number. Tasks count runs of pairs and send each bucket of them as
one sorted, packed row, so a pair takes two or three bytes of shuffle and scratch. Nothing is left out.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# words whose pairs are made at a time, and pairs that are counted at a time
PAIR_WORDS = 1 << 17
HELD_PAIRS = 1 << 22
# counts in a packed row, unless one row of a matrix has more
PACKED_KEYS = 1 << 20
# second words that go to one bucket together
BUCKET_WORDS = 12
PACKED = "bucket int, n long, keys binary, counts binary"
# rows that are unpacked at a time
SENT_ROWS = 1 << 16


def pack_numbers(values: np.ndarray) -> bytes:
    """Whole numbers of no more bytes than the largest needs, the first byte of all first."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if values.max(initial=0) <= np.iinfo(k).max)
    size = np.dtype(kind).itemsize
    planes = values.astype(kind)
    if size > 1:
        planes = np.stack([(planes >> kind(8 * k)).astype(np.uint8) for k in range(size)])
    return bytes([size]) + pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def unpack_numbers(data: pa.Buffer, n: int) -> np.ndarray:
    size = data[0]
    planes = np.frombuffer(pa.Codec("zstd").decompress(data.slice(1), decompressed_size=size * n), np.uint8)
    values = planes[:n].astype(np.int64)
    for k in range(1, size):
        values |= planes[k * n : (k + 1) * n].astype(np.int64) << (8 * k)
    return values


def pack(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A batch of PACKED from (bucket, sorted keys, counts)."""
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    columns = [
        [bucket for bucket, _, _ in rows], [len(keys) for _, keys, _ in rows],
        [pack_numbers(np.diff(keys, prepend=0)) for _, keys, _ in rows], [pack_numbers(counts) for _, _, counts in rows],
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, kinds)], ["bucket", "n", "keys", "counts"]
    )


def unpack(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, keys, counts) of each row of PACKED."""
    for i in range(batch.num_rows):
        n = batch.column(1)[i].as_py()
        steps, counts = (unpack_numbers(batch.column(c)[i].as_buffer(), n) for c in (2, 3))
        yield batch.column(0)[i].as_py(), np.cumsum(steps), counts


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, each with the sum of its counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    return key[starts], np.add.reduceat(n, starts) if len(starts) else n


def _cut(keys: np.ndarray, row_keys: int) -> Iterator[tuple[int, int]]:
    """Runs of about PACKED_KEYS keys; with `row_keys`, keys of one row of a matrix are not parted."""
    begin = 0
    while begin < len(keys):
        stop = min(begin + PACKED_KEYS, len(keys))
        if row_keys and stop < len(keys):
            row = keys[stop] // row_keys
            stop = int(np.searchsorted(keys, row * row_keys))
            if stop == begin:
                stop = int(np.searchsorted(keys, (row + 1) * row_keys))
        yield begin, stop
        begin = stop


def _merged(row_keys: int = 0) -> Callable:
    """Adds up the packed rows of a task. Buckets have no key in common."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0
        for batch in batches:
            for _, key, n in unpack(batch):
                keys.append(key)
                counts.append(n)
                size += len(key)
                if size > 2 * HELD_PAIRS and len(keys) > 1:
                    key, n = _added(keys, counts)
                    # nothing met: wait for twice as much
                    keys, counts, size = [key], [n], 0 if 2 * len(key) > size else len(key)
        if keys:
            key, n = _added(keys, counts)
            for begin, stop in _cut(key, row_keys):
                yield pack([(0, key[begin:stop], n[begin:stop])])

    return merged


def count_pairs(
    texts: DataFrame, known: pa.Array | None, n_words: int, window: int, total: int, ordered: bool = False,
    span: int = PAIR_WORDS, held_pairs: int = HELD_PAIRS,
) -> DataFrame:
    """PACKED pairs a * n_words + b of words at most `window` apart, each pair once; a <= b unless `ordered`.

    Column `words` of `texts` holds words, whose numbers are their places in `known`, or numbers. A word
    without a number keeps its place in the text and makes no pair. `total` is about how many words there are.
    """
    context = texts.sparkSession.sparkContext
    shipped = None if known is None else context.broadcast(known)
    buckets = max(-(-total * window // HELD_PAIRS), context.defaultParallelism, 1)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        # second words near each other stay together, a first word with many goes to many buckets
        group = (keys // n_words) * 0x9E3779B1 + ((keys % n_words) >> BUCKET_WORDS) * 0x85EBCA6B
        bucket = ((group ^ (group >> 15)) & 0x7FFFFFFF) % buckets
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        return pack([
            (i, keys[order[a:b]], n[order[a:b]]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b
        ])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            words = batch.column(0)
            flat = words.flatten()
            if shipped is not None:
                flat = pc.index_in(flat, value_set=shipped.value.cast(flat.type), skip_nulls=True)
            number = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(words)), sizes)
            for begin in range(0, len(number), span):
                for gap in range(1, window + 1):
                    second, other = number[begin + gap : begin + span + gap], text[begin + gap : begin + span + gap]
                    first = number[begin : begin + len(second)]
                    own = (first >= 0) & (second >= 0) & (text[begin : begin + len(second)] == other)
                    first, second = first[own], second[own]
                    if not ordered:
                        first, second = np.minimum(first, second), np.maximum(first, second)
                    held.append(first * n_words + second)
                    size += len(first)
                if size > held_pairs:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    found = texts.select("words").mapInArrow(pairs, PACKED).repartitionById(buckets, F.col("bucket"))
    return found.mapInArrow(_merged(), PACKED)


def pair_rows(packed: DataFrame, n_words: int, min_count: int = 1) -> DataFrame:
    """(a, b, n) of packed pairs counted often enough."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, keys, n in unpack(batch):
                keys, n = keys[n >= min_count], n[n >= min_count]
                for begin in range(0, len(keys), SENT_ROWS):
                    a, b = np.divmod(keys[begin : begin + SENT_ROWS], n_words)
                    yield pa.RecordBatch.from_pydict({
                        "a": pa.array(a.astype(np.int32)), "b": pa.array(b.astype(np.int32)),
                        "n": pa.array(n[begin : begin + SENT_ROWS]),
                    })

    return packed.mapInArrow(rows, "a int, b int, n long")


# ------------------------------------------------------------------ square matrices


def square(
    packed: DataFrame, n_words: int, cells: np.ndarray, keep: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
) -> DataFrame:
    """PACKED cells a * n_words + b in both directions of the pairs (a <= b) that `keep` takes.

    `cells` is how many cells a row has at most; rows are dealt in runs of HELD_PAIRS of them or less. All
    cells of a row lie in one packed row.
    """
    before = np.cumsum(cells) - cells
    total, cores = max(int(cells.sum()), 1), packed.sparkSession.sparkContext.defaultParallelism
    run = max(min(HELD_PAIRS, total // (4 * cores)), PACKED_KEYS // 16)
    starts = np.searchsorted(before, np.arange(0, total, run))
    starts = np.unique(np.minimum(starts, n_words - 1)) * n_words

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, keys, n in unpack(batch):
                a, b = np.divmod(keys, n_words)
                kept = keep(a, b, n)
                a, b, n = a[kept], b[kept], n[kept]
                apart = a != b
                key = np.concatenate([a * n_words + b, (b * n_words + a)[apart]])
                n = np.concatenate([n, n[apart]])
                order = np.argsort(key, kind="stable")
                key, n = key[order], n[order]
                cuts = [*np.searchsorted(key, starts)[1:], len(key)]
                parts = [(i, key[x:y], n[x:y]) for i, (x, y) in enumerate(zip([0, *cuts], cuts)) if x < y]
                if parts:
                    yield pack(parts)

    dealt = packed.mapInArrow(turned, PACKED).repartitionById(len(starts), F.col("bucket"))
    return dealt.mapInArrow(_merged(n_words), PACKED)


# rows of a dense factor that a task makes at a time, and cells that are weighed at a time: as many as
# stay in the cache
FACTOR_ROWS = 4_096
WEIGHED_CELLS = 1_024


def reserve(path: str, rows: int, width: int) -> str:
    """A file of zeros for rows of doubles, which tasks write in place; on a mounted folder."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as file:
        file.truncate(rows * width * 8)
    return path


def mapped(path: str, width: int) -> np.ndarray:
    return np.asarray(np.memmap(path, np.float64, "r")).reshape(-1, width)


def write_rows(path: str, first: int, rows: np.ndarray) -> None:
    """A task that runs again writes the same bytes."""
    with open(path, "r+b") as file:
        file.seek(first * rows.shape[1] * 8)
        file.write(np.ascontiguousarray(rows).tobytes())


def weighed_sums(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray | None, q: np.ndarray, out: np.ndarray
) -> np.ndarray:
    """Add to each row of `out` the sum of value times row `column` of `q` over its cells; `rows` in order.

    Rows with the same number of cells are one product.
    """
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    sizes = np.diff(starts, append=len(rows))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for own in np.split(order, cuts) if len(order) else ():
        size = int(sizes[own[0]])
        if size > WEIGHED_CELLS:
            for begin, at in ((b, slice(b, min(b + WEIGHED_CELLS, s + size))) for s in starts[own] for b in range(s, s + size, WEIGHED_CELLS)):
                part = q.take(columns[at], axis=0)
                out[rows[begin]] += part.sum(axis=0) if values is None else values[at] @ part
            continue
        step = WEIGHED_CELLS // size
        for begin in range(0, len(own), step):
            first = starts[own[begin : begin + step]]
            at = first[:, None] + np.arange(size)
            part = q.take(columns[at], axis=0)
            out[rows[first]] += part.sum(axis=1) if values is None else np.matmul(values[at][:, None], part)[:, 0]
    return out


def multiply(
    matrix: DataFrame, n_words: int, value: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
    source: str, factor: np.ndarray, target: str,
) -> str:
    """Rows of (matrix times the rows of file `source`) times `factor`, each in its place in file `target`."""
    reserve(target, n_words, factor.shape[1])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, done = mapped(source, len(factor)), 0
        for batch in batches:
            for _, keys, n in unpack(batch):
                a, b = np.divmod(keys, n_words)
                for begin, stop in _near(a):
                    own, first = slice(begin, stop), int(a[begin])
                    size = int(a[stop - 1]) - first + 1
                    sums = np.zeros((size, len(factor)))
                    weighed_sums(a[own] - first, b[own], value(a[own], b[own], n[own]), q, sums)
                    write_rows(target, first, sums @ factor)
                done += len(keys)
        yield pa.RecordBatch.from_pydict({"n": pa.array([done], pa.int64())})

    matrix.mapInArrow(products, "n long").agg(F.sum("n")).collect()
    return target


def _near(rows: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of cells whose rows lie in one range of FACTOR_ROWS."""
    cuts = np.flatnonzero(np.diff(rows // FACTOR_ROWS)) + 1
    yield from zip([0, *cuts], [*cuts, len(rows)])


def factor_ranges(spark, n_rows: int) -> DataFrame:
    """(first): starts of ranges of FACTOR_ROWS rows, dealt to the cores."""
    ranges = max(-(-n_rows // FACTOR_ROWS), 1)
    parts = max(min(ranges, spark.sparkContext.defaultParallelism), 1)
    return spark.range(0, ranges, 1, parts).select((F.col("id") * FACTOR_ROWS).alias("first"))
