"""Exact deduplication by Grace hashing.

Each task first folds equal texts of its own rows, so that a text that is a third of all rows
travels once per task and not once per row. The folded records are dealt by the hash of their
text. A task that receives them fills an open-addressing table which compares whole texts; when
the table outgrows its budget, its entries and the rest of the records go to spill files by the
next bits of the hash, and each file is treated in the same way until its texts fit.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyrank.llm.common import row_of, small_batches
from storyrank.sources.scratch import stored

FANOUT_BITS = 4
HASH_BITS = 64
ROW_BITS = 33


@dataclass(frozen=True)
class GraceConfig:
    """Bytes of text that a table holds before its records are spilled, and rows of a batch."""

    fold_bytes: int = 24 * 1024 * 1024
    table_bytes: int = 48 * 1024 * 1024
    out_rows: int = 4_000


def normal_bytes(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


class OpenTable:
    """Open addressing with linear probing; a key is found by comparing the whole content."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 64
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def place(self, key: int, content: bytes) -> tuple[int, bool]:
        """Number of the entry that holds `content`, and whether it is new."""
        if 2 * len(self.contents) >= len(self.slots):
            self._grow()
        mask = len(self.slots) - 1
        at = key & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == key and self.contents[entry] == content:
                return entry, False
            at = (at + 1) & mask
        self.slots[at] = len(self.contents)
        self.hashes.append(key)
        self.contents.append(content)
        self.bytes += len(content) + 200
        return self.slots[at], True

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, key in enumerate(self.hashes):
            at = key & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def _hash64(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big")


def _signed(key: int) -> int:
    return key - (1 << HASH_BITS) if key >> (HASH_BITS - 1) else key


# --------------------------------------------------------------------- fold in a task


def _fold(batches: Iterable[pa.RecordBatch], schema: pa.Schema, cfg: GraceConfig, members: bool):
    """Fold equal texts within a task.

    A folded record carries the best row of its texts (largest id, then first seen) and the
    number of rows. With `members` every row is also given, as (uid, rep) without content.
    """
    next_uid = TaskContext.get().partitionId() << ROW_BITS
    table, best, held = OpenTable(), [], []
    rows: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal table, best, held, rows
        if best:
            whole = pa.Table.from_batches(held).combine_chunks()
            picked = whole.column("row").take(pa.array([b["at"] for b in best]))
            count = len(best)
            for begin in range(0, count, cfg.out_rows):
                part = best[begin : begin + cfg.out_rows]
                yield _batch(schema, {
                    "uid": [b["uid"] for b in part],
                    "rep": [b["rep"] for b in part],
                    "id": [b["id"] for b in part],
                    "n": [b["n"] for b in part],
                    "hash": [_signed(h) for h in table.hashes[begin : begin + cfg.out_rows]],
                    "row": picked.slice(begin, len(part)),
                    "folded": [True] * len(part),
                })
            for begin in range(0, len(rows) if members else 0, 50_000):
                part = rows[begin : begin + 50_000]
                yield _batch(schema, {
                    "uid": [r[0] for r in part],
                    "rep": [r[1] for r in part],
                    "id": [r[2] for r in part],
                    "folded": [False] * len(part),
                })
        table, best, held, rows = OpenTable(), [], [], []

    start = 0
    for batch in batches:
        held.append(batch)
        for i, (id_, text) in enumerate(zip(batch.column("id").to_pylist(), _texts(batch))):
            content = normal_bytes(text)
            key = _hash64(hashlib.sha256(content).digest())
            entry, new = table.place(key, content)
            if new:
                best.append({"uid": next_uid, "rep": next_uid, "id": id_, "n": 0, "at": start + i})
            kept = best[entry]
            kept["n"] += 1
            if not new and id_ is not None and (kept["id"] is None or id_ > kept["id"]):
                kept.update(uid=next_uid, id=id_, at=start + i)
            if members:
                rows.append((next_uid, kept["rep"], id_))
            next_uid += 1
        start += batch.num_rows
        if table.bytes >= cfg.fold_bytes or sum(b.nbytes for b in held) >= 2 * cfg.fold_bytes:
            yield from flush()
            start = 0
    yield from flush()


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column("row").field(0).to_pylist()


def _batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    arrays = []
    for f in schema:
        values = columns.get(f.name)
        if values is None:
            arrays.append(pa.nulls(size, f.type))
        elif isinstance(values, (pa.Array, pa.ChunkedArray)):
            chunk = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
            arrays.append(chunk.cast(f.type) if chunk.type != f.type else chunk)
        else:
            arrays.append(pa.array(values, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


# ------------------------------------------------------------------ recursive buckets


@dataclass
class _Class:
    """Copies of one text: best record so far, all folded records and rows."""

    record: dict
    n: int
    reps: list[int] = field(default_factory=list)


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        names = ("uid", "rep", "id", "n", "hash")
        columns = [batch.column(c).to_pylist() for c in names]
        for i, (values, text) in enumerate(zip(zip(*columns), _texts(batch))):
            record = dict(zip(names, values))
            record["hash"] %= 1 << HASH_BITS
            record |= {"content": normal_bytes(text), "row": (batch, i), "reps": [record["rep"]]}
            yield record


def _better(a: dict, b: dict) -> bool:
    """Whether record `a` goes before `b`: larger id, null last, then the smaller row number."""
    if a["id"] != b["id"]:
        return b["id"] is None or (a["id"] is not None and a["id"] > b["id"])
    return a["uid"] < b["uid"]


def _bucket(
    records: Iterator[dict], level: int, schema: pa.Schema, cfg: GraceConfig, folder: str
) -> Iterator[tuple[bytes, _Class]]:
    """Classes of equal text; `level` hash digits have been used for this bucket."""
    table, classes = OpenTable(), []
    deepest = (level + 1) * FANOUT_BITS > HASH_BITS
    for record in records:
        entry, new = table.place(record["hash"], record["content"])
        if new:
            classes.append(_Class(record, record["n"], list(record["reps"])))
        else:
            known = classes[entry]
            known.n += record["n"]
            known.reps.extend(record["reps"])
            if _better(record, known.record):
                known.record = record
        if table.bytes > cfg.table_bytes and len(classes) > 1 and not deepest:
            held = [c.record | {"n": c.n, "reps": c.reps} for c in classes]
            table, classes = OpenTable(), []
            files = _spill(held, records, level, schema, cfg, folder)
            for path in files:
                yield from _bucket(_unspill(path), level + 1, schema, cfg, folder)
                os.remove(path)
            return
    yield from zip(table.contents, classes)


SPILL = [("uid", pa.int64()), ("n", pa.int64()), ("hash", pa.uint64()), ("reps", pa.list_(pa.int64()))]


def _spill(
    held: list[dict], rest: Iterator[dict], level: int, schema: pa.Schema, cfg: GraceConfig, folder: str
) -> list[str]:
    """Deal records to files by the hash digit of this level."""
    fields = [*SPILL, ("id", schema.field("id").type), ("row", schema.field("row").type)]
    spilled = pa.schema(fields)
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    shift = HASH_BITS - (level + 1) * FANOUT_BITS
    waiting: list[list[dict]] = [[] for _ in range(1 << FANOUT_BITS)]
    writers: dict[int, tuple] = {}

    def write(digit: int) -> None:
        part, waiting[digit] = waiting[digit], []
        if digit not in writers:
            path = tempfile.mkstemp(suffix=".arrow", dir=folder)[1]
            writers[digit] = (path, pa.ipc.new_stream(path, spilled, options=options))
        columns = {k: [r[k] for r in part] for k in ("uid", "n", "hash", "reps", "id")}
        rows = pa.concat_arrays([b.column("row").slice(i, 1) for b, i in (r["row"] for r in part)])
        writers[digit][1].write_batch(_batch(spilled, columns | {"row": rows}))

    sizes = [0] * len(waiting)
    for source in (held, rest):
        for record in source:
            digit = (record["hash"] >> shift) & (len(waiting) - 1)
            waiting[digit].append(record)
            sizes[digit] += len(record["content"]) + 200
            if sizes[digit] > cfg.table_bytes >> (FANOUT_BITS + 1):
                write(digit)
                sizes[digit] = 0
    for digit, part in enumerate(waiting):
        if part:
            write(digit)
    for _, writer in writers.values():
        writer.close()
    return [path for path, _ in writers.values()]


def _unspill(path: str) -> Iterator[dict]:
    with pa.memory_map(path) as file, pa.ipc.open_stream(file) as reader:
        for batch in reader:
            names = ("uid", "n", "hash", "reps", "id")
            columns = [batch.column(c).to_pylist() for c in names]
            for i, (values, text) in enumerate(zip(zip(*columns), _texts(batch))):
                yield dict(zip(names, values)) | {"content": normal_bytes(text), "row": (batch, i)}


def _classes(batches: Iterable[pa.RecordBatch], schema: pa.Schema, cfg: GraceConfig):
    # spill files live and die inside the task, on the disk of its own executor
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        yield from _bucket(_records(batches), 0, schema, cfg, folder)


# --------------------------------------------------------------------------- operator


def _packed(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, row): the text first in the row, then all columns as one struct."""
    return df.select(
        F.col(id_col).alias("id"),
        F.struct(F.col(text_col).alias("text"), *([] if df.columns == [text_col] else [row_of(
            df.drop(text_col)).alias("rest")])).alias("row"),
    )


def _folded(df: DataFrame, text_col: str, id_col: str, cfg: GraceConfig, members: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    packed = _packed(df, text_col, id_col)
    row, id_ = packed.schema["row"].dataType, packed.schema["id"].dataType
    out = T.StructType([
        T.StructField("uid", T.LongType()),
        T.StructField("rep", T.LongType()),
        T.StructField("id", id_),
        T.StructField("n", T.LongType()),
        T.StructField("hash", T.LongType()),
        T.StructField("folded", T.BooleanType()),
        T.StructField("row", row),
    ])
    schema = to_arrow_schema(out)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _fold(batches, schema, cfg, members)

    return packed.mapInArrow(fold, out)


def _dealt(folded: DataFrame) -> DataFrame:
    return folded.select("uid", "rep", "id", "n", "hash", "row").repartition("hash")


def duplicate_classes(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", cfg: GraceConfig = GraceConfig()
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal
    texts the row with the largest id stays; a null id is smaller than any other, and of repeated
    rows with the same id exactly one is kept. Other columns are not read. An empty table gives an
    empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    folded = stored(_folded(narrow, "text", "id", cfg, members=True), "grace")
    out = T.StructType([
        T.StructField("class_rep", T.LongType()),
        T.StructField("keep_uid", T.LongType()),
        T.StructField("keep_id", folded.schema["id"].dataType),
        T.StructField("group_size", T.LongType()),
        T.StructField("text_sha256", T.StringType()),
    ])
    schema = to_arrow_schema(out)
    dealt = _dealt(folded.filter("folded"))
    arriving = to_arrow_schema(dealt.schema)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for content, found in _classes(batches, arriving, cfg):
            digest = hashlib.sha256(content).hexdigest()
            kept = found.record
            for rep in found.reps:
                rows.append((rep, kept["uid"], kept["id"], found.n, digest))
                if len(rows) >= cfg.out_rows:
                    yield _batch(schema, dict(zip(schema.names, zip(*rows))))
                    rows = []
        if rows:
            yield _batch(schema, dict(zip(schema.names, zip(*rows))))

    decided = dealt.mapInArrow(classes, out)
    members = folded.filter(~F.col("folded")).select("uid", "rep", "id")
    return members.join(decided, F.col("rep") == F.col("class_rep")).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("uid") == F.col("keep_uid")).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", cfg: GraceConfig = GraceConfig()
) -> DataFrame:
    """The rows of `df` that stay, all columns as they were; same rules as `duplicate_classes`."""
    from pyspark.sql.pandas.types import to_arrow_schema

    dealt = _dealt(_folded(df, text_col, id_col, cfg, members=False))
    arriving = to_arrow_schema(dealt.schema)
    out = T.StructType([dealt.schema["row"]])
    schema = to_arrow_schema(out)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for content, found in _classes(batches, arriving, cfg):
            batch, i = found.record["row"]
            part.append(batch.column("row").slice(i, 1))
            size += len(content)
            if len(part) >= cfg.out_rows or size >= cfg.fold_bytes:
                yield _batch(schema, {"row": pa.concat_arrays(part)})
                part, size = [], 0
        if part:
            yield _batch(schema, {"row": pa.concat_arrays(part)})

    rest = {c: F.col("row.rest")[c] for c in df.columns if c != text_col}
    rest[text_col] = F.col("row.text")
    return dealt.mapInArrow(kept, out).select(*[rest[c].alias(c) for c in df.columns])
