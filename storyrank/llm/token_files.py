"""Flat token files: unsigned ids of one width, 64-bit document offsets, read by memory mapping.

A folder holds, for each part, `NAME.ids` (little-endian ids, 16 bits wide when the vocabulary
allows it, else 32), `NAME.off` (int64: ids of the part before each document, then their number)
and `NAME.doc` (int64 document ids). The parts list tells which files count, how many ids and
documents lie before each part, and the width; the first two are prefix sums over the parts.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyrank.llm.common import small_batches
from storyrank.llm.tokens import ENCODED_TOGETHER, TokenizerSpec, encoder

NULL_ID = -(1 << 63)
PARTS = "part int, name string, docs long, tokens long, dtype string"
LISTED = "parts.json"


@dataclass(frozen=True)
class Part:
    """Files of one part and what lies before it."""

    name: str
    dtype: str
    docs: int
    tokens: int
    docs_before: int
    tokens_before: int


def write_token_files(
    df: DataFrame,
    folder: str,
    tokenizer: TokenizerSpec,
    end_id: int,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> list[Part]:
    """Encode all texts and write them in ascending order of id; returns the parts in that order.

    Documents are dealt in ranges of their id and sorted, so part after part is the whole order; a
    null text is empty and gives the end id alone, a null id comes first and is stored as the
    smallest int64, rows that repeat an id stand side by side. Each attempt of a task writes files
    of its own name and only those of the attempt that succeeded are listed, so retries and lost
    executors leave no wrong part. `folder` is a path all executors and the driver see.
    """
    small_batches(df.sparkSession, *ENCODED_TOGETHER)
    shipped = tokenizer.ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # an id that many rows share, null too, is cut by text and row
    place = ["id", "hash", "row"]
    told = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = told.repartitionByRange(*place).sortWithinPartitions(*place).select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(shipped)
        encode, dtype = known.encode, known.dtype.str
        number = TaskContext.get().partitionId()
        name = f"part-{number:05d}-{uuid.uuid4().hex}"
        store, root = fs.FileSystem.from_uri(folder)
        lengths, ids, out = [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}.ids")
            found, begins = encode(batch.column(1))
            out.write(np.insert(found, begins[1:], end_id).astype(dtype).tobytes())
            lengths.append(np.diff(begins) + 1)
            ids.append(batch.column(0).fill_null(NULL_ID).to_numpy())
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8")
        docs = np.concatenate(ids).astype("<i8")
        for suffix, values in (("off", offsets), ("doc", docs)):
            with store.open_output_stream(f"{root}/{name}.{suffix}") as file:
                file.write(values.tobytes())
        columns = [[number], [name], [len(docs)], [int(offsets[-1])], [dtype]]
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        yield pa.RecordBatch.from_arrays(arrays, ["part", "name", "docs", "tokens", "dtype"])

    # one row per part: file names and two counts, as in the list of a table's files
    written = ordered.mapInArrow(write, PARTS).collect()
    parts, docs, tokens = [], 0, 0
    for row in sorted(written, key=lambda r: r["part"]):
        parts.append(Part(row["name"], row["dtype"], row["docs"], row["tokens"], docs, tokens))
        docs, tokens = docs + row["docs"], tokens + row["tokens"]
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{LISTED}") as file:
        file.write(json.dumps([asdict(p) for p in parts]).encode())
    return parts


def list_parts(folder: str) -> list[Part]:
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/{LISTED}") as file:
        return [Part(**p) for p in json.loads(file.read())]


class PartReader:
    """Documents of one part through memory-mapped arrays."""

    def __init__(self, folder: str, part: Part) -> None:
        store, root = fs.FileSystem.from_uri(folder)
        if not isinstance(store, fs.LocalFileSystem):
            raise ValueError("memory mapping needs a folder that is mounted on the executors")
        self.part = part
        self.ids = np.memmap(f"{root}/{part.name}.ids", part.dtype, "r")
        self.offsets = np.memmap(f"{root}/{part.name}.off", "<i8", "r")
        self.docs = np.memmap(f"{root}/{part.name}.doc", "<i8", "r")

    def __len__(self) -> int:
        return len(self.docs)

    def tokens(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]

    def start(self, i: int) -> int:
        return self.part.tokens_before + int(self.offsets[i])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, one task per part."""
    parts = list_parts(folder)
    schema = "name string, dtype string, docs long, tokens long, docs_before long, tokens_before long"
    listed = spark.createDataFrame([tuple(asdict(p).values()) for p in parts], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fields in batch.to_pylist():
                reader = PartReader(folder, Part(**fields))
                for begin in range(0, len(reader), 10_000):
                    at = range(begin, min(begin + 10_000, len(reader)))
                    docs = np.array(reader.docs[begin : at.stop])
                    crcs = [zlib.crc32(reader.tokens(i).astype("<u4").tobytes()) for i in at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs, mask=docs == NULL_ID),
                            pa.array([reader.start(i) for i in at], pa.int64()),
                            pa.array(np.diff(reader.offsets[begin : at.stop + 1])),
                            pa.array(crcs, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    tasks = max(len(parts), 1)
    return listed.repartition(tasks, "name").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
