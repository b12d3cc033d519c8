"""Which files of an id-keyed table may hold some of a few ids.

Beside the table stands an index with one row per file: a Bloom filter of its ids. A small load
tests its ids against the filters, 12 bits for each id ever stored, and opens only the files that
answer; one id in some 300 answers falsely, which costs a look at a file and nothing else. Rows of
the index are written before their file, so an attempt that fails in between leaves a filter
without a file, never a file without a filter.

The index is one folder per generation. Loads append to the newest whole generation; after
`merge_every` appends its rows are written into the next one as a few files, so the number of small
files stays bounded. A generation that was not finished has no `_SUCCESS` and is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyrank.sources import files

SCHEMA = "part string, buckets int, bucket int, bits binary"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


@dataclass(frozen=True)
class MemberConfig:
    """`ids_per_file`, `bytes_per_file`: size of the files that a load is dealt into, in ids and in bytes
    of text, whichever makes more files. `probe_ids`: a load with more ids than that reads the whole
    table instead of the index."""

    ids_per_file: int = 1_000_000
    bytes_per_file: int = 128 * 1024 * 1024
    bits_per_id: int = 12
    hashes: int = 8
    probe_ids: int = 100_000
    merge_every: int = 64


def id_hash(column: str) -> Column:
    return F.xxhash64(column)


def buckets_for(ids: int, size: int, cfg: MemberConfig) -> int:
    """Files of a load with so many ids and bytes."""
    return max(-(-ids // cfg.ids_per_file), -(-size // cfg.bytes_per_file), 1)


def with_part(rows: DataFrame, load: int, buckets: int, column: str = "id_str") -> DataFrame:
    """Add `bucket` by the hash of the id, and `part`, the name of the file group it goes to."""
    bucket = F.pmod(id_hash(column), F.lit(buckets)).cast("int")
    # letters between the numbers: the name is not taken for a date
    part = F.concat(F.lit(f"load{load}of{buckets}n"), F.col("bucket").cast("string"))
    return rows.withColumn("bucket", bucket).withColumn("part", part)


def _positions(hashes: np.ndarray, n_bits: int, k: int) -> np.ndarray:
    """Places of the `k` bits of each 64-bit hash."""
    with np.errstate(over="ignore"):
        h = hashes.astype(np.uint64)
        a, b = h * _MIX[0], (h ^ (h >> np.uint64(29))) * _MIX[1]
        mixed = a[:, None] + (b | np.uint64(1))[:, None] * np.arange(k, dtype=np.uint64)
        return ((mixed >> np.uint64(11)) % np.uint64(n_bits)).astype(np.int64)


def make_filter(hashes: np.ndarray, cfg: MemberConfig) -> bytes:
    n_bits = max(len(hashes) * cfg.bits_per_id, 64)
    marks = np.zeros(-(-n_bits // 8) * 8, bool)
    marks[_positions(hashes, len(marks), cfg.hashes).ravel()] = True
    return np.packbits(marks).tobytes()


def hits(bits, hashes: np.ndarray, cfg: MemberConfig) -> np.ndarray:
    """Whether each hash may be in a filter."""
    marks = np.unpackbits(np.frombuffer(bits, np.uint8))
    return marks[_positions(hashes, len(marks), cfg.hashes)].all(axis=1)


def index_root(table: str) -> str:
    return f"{table.rstrip('/')}.members"


def _generation(spark: SparkSession, root: str) -> int:
    """The newest finished generation, -1 when there is none."""
    names = [n for n in files.children(spark, root) if n.startswith("g") and n[1:].isdigit()]
    for number in sorted((int(n[1:]) for n in names), reverse=True):
        if files.exists(spark, f"{root}/g{number}/_SUCCESS"):
            return number
    return -1


def read_index(spark: SparkSession, table: str) -> DataFrame | None:
    root = index_root(table)
    newest = _generation(spark, root)
    return None if newest < 0 else spark.read.schema(SCHEMA).parquet(f"{root}/g{newest}")


def add_filters(rows: DataFrame, table: str, buckets: int, cfg: MemberConfig = MemberConfig()) -> None:
    """Append the filters of rows (id_str, bucket, part), one for each part."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[np.ndarray]] = {}
        for batch in batches:
            bucket, hashed = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for number in np.unique(bucket):
                own = np.flatnonzero(bucket == number)
                found.setdefault((batch.column(0)[int(own[0])].as_py(), int(number)), []).append(hashed[own])
        for (part, number), parts in found.items():
            bits = make_filter(np.concatenate(parts), cfg)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part]), "buckets": pa.array([buckets], pa.int32()),
                "bucket": pa.array([number], pa.int32()), "bits": pa.array([bits], pa.binary()),
            })

    spark, root = rows.sparkSession, index_root(table)
    narrow = rows.select("part", "bucket", id_hash("id_str").alias("h"))
    made = narrow.repartitionById(buckets, F.col("bucket")).mapInArrow(build, SCHEMA)
    newest = max(_generation(spark, root), 0)
    made.write.mode("append").parquet(f"{root}/g{newest}")
    if len(files.children(spark, f"{root}/g{newest}")) > cfg.merge_every:
        whole = spark.read.schema(SCHEMA).parquet(f"{root}/g{newest}")
        # one file for about as many filters as fill it: 1.5 MB each at the most
        few = max(whole.count() * cfg.ids_per_file * cfg.bits_per_id // (8 * 256_000_000), 1)
        whole.coalesce(int(few)).write.mode("overwrite").parquet(f"{root}/g{newest + 1}")


def may_hold(spark: SparkSession, table: str, hashes: np.ndarray, cfg: MemberConfig = MemberConfig()) -> list[str]:
    """Paths of the parts of `table` whose filter answers to one of the hashes."""
    index = read_index(spark, table)
    if index is None or len(hashes) == 0:
        return []
    shipped = spark.sparkContext.broadcast(hashes)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shipped.value
        for batch in batches:
            answer = []
            named = zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3))
            for part, buckets, bucket, bits in named:
                # the bucket of a hash as the engine counts it, never negative
                own = wanted[np.mod(wanted, buckets) == bucket]
                if len(own) and hits(bits.as_buffer(), own, cfg).any():
                    answer.append(part)
            yield pa.RecordBatch.from_pydict({"part": pa.array(answer, pa.string())})

    named = [r["part"] for r in index.mapInArrow(probe, "part string").distinct().collect()]
    shipped.unpersist()
    paths = [f"{table.rstrip('/')}/part={name}" for name in sorted(named)]
    return [p for p in paths if files.exists(spark, p)]
