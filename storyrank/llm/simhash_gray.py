"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are dealt by every choice of `blocks - max_bits` of their blocks, so that two of them
within `max_bits` bits meet in at least one bucket. Within a bucket they are sorted by Gray rank,
runs of them form nodes that keep the bits all members share, and nodes form upper nodes in the
same way. A search goes down with the differences gathered so far on the shared bits, drops a
whole node when these exceed the bound, and accepts it whole when the bits it does not share
cannot exceed the bound any more. (Gray order and fixed-mask nodes: Tang et al., 2015.)
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyrank.llm.common import component_labels, row_of, small_batches
from storyrank.sources.scratch import stored

SEED = 42
ALL_BITS = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class SimHashConfig:
    """`shingle` words, links at `max_bits` or fewer; fan-out and chunk sizes change speed only.

    A bucket of more than `bucket_rows` fingerprints is split into parts and treated as pairs of
    parts, so no link is lost and no task receives more than two parts of it.
    """

    shingle: int = 3
    max_bits: int = 3
    blocks: int = 4
    fanout: int = 16
    bucket_rows: int = 16_384
    queries: int = 8_192
    index_rows: int = 131_072


# ----------------------------------------------------------------------- fingerprints


def fingerprint_of(text: str | None, shingle: int) -> int:
    """64-bit SimHash; a bit is 1 when set in over half of the shingle hashes."""
    words = b"" if text is None else text.encode("utf-8", "surrogatepass").lower()
    words = words.split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        starts = [0, *ends[: -shingle].tolist()]
        stops = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, stops)]
    bits = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), 65_536):
        part = np.array(hashes[begin : begin + 65_536], np.uint64)
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes)).view(np.uint64)[0])


def fingerprints(df: DataFrame, text_col: str = "text", cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """(row, fp): all columns as one struct and the fingerprint as a signed long."""
    small_batches(df.sparkSession)
    shingle = cfg.shingle

    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        found = (fingerprint_of(t, shingle) for t in texts.to_pylist())
        return pa.array(np.fromiter(found, np.uint64, len(texts)).view(np.int64))

    return df.select(row_of(df).alias("row"), fingerprint(F.col(text_col)).alias("fp"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ------------------------------------------------------------------ hierarchical index


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


@dataclass
class _Level:
    """Nodes of one level: rows [first, last], children [begin, end) below, shared bits."""

    first: np.ndarray
    last: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    pattern: np.ndarray
    mask: np.ndarray
    fresh: np.ndarray


def build_levels(bucket: np.ndarray, fps: np.ndarray, fanout: int) -> list[_Level]:
    """Levels from the rows up to one node per bucket; rows are in (bucket, Gray rank) order."""
    n = len(fps)
    rows = np.arange(n)
    levels = [_Level(rows, rows, rows, rows, fps, np.full(n, ALL_BITS), np.full(n, ALL_BITS))]
    groups, both, either = bucket, fps, fps
    while len(groups) > len(np.unique(groups)) or len(levels) == 1:
        below = levels[-1]
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        within = np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))
        begin = np.flatnonzero(within % fanout == 0)
        end = np.r_[begin[1:], len(groups)]
        both = np.bitwise_and.reduceat(both, begin)
        either = np.bitwise_or.reduceat(either, begin)
        mask = ~(both ^ either)
        parent = np.repeat(np.arange(len(begin)), end - begin)
        below.fresh = below.mask & ~mask[parent]
        levels.append(_Level(below.first[begin], below.last[end - 1], begin, end, both, mask, mask))
        groups = groups[begin]
    return levels


def search_links(bucket: np.ndarray, fps: np.ndarray, cfg: SimHashConfig) -> np.ndarray:
    """Label of each row: smallest row of its bucket that links reach.

    Rows are in (bucket, Gray rank) order. A row looks only for partners after it.
    """
    levels = build_levels(bucket, fps, cfg.fanout)
    top = levels[-1]
    root = np.repeat(np.arange(len(top.first)), top.last - top.first + 1)
    labels = np.arange(len(fps))
    for start in range(0, len(fps), cfg.queries):
        query = np.arange(start, min(start + cfg.queries, len(fps)))
        node = root[query]
        gathered = np.zeros(len(query), np.uint8)
        for depth in range(len(levels) - 1, -1, -1):
            level = levels[depth]
            differ = (fps[query] ^ level.pattern[node]) & level.fresh[node]
            gathered = gathered + np.bitwise_count(differ)
            near = (gathered <= cfg.max_bits) & (level.last[node] > query)
            query, node, gathered = query[near], node[near], gathered[near]
            whole = gathered + np.bitwise_count(~level.mask[node]) <= cfg.max_bits
            if whole.any():
                # all members are within the bound of each other and of the query
                labels = _merged(labels, query[whole], level.first[node[whole]])
                labels = _merged(labels, query[whole], level.last[node[whole]])
                query, node, gathered = query[~whole], node[~whole], gathered[~whole]
            if depth:
                fan = level.end[node] - level.begin[node]
                offset = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
                query, gathered = np.repeat(query, fan), np.repeat(gathered, fan)
                node = np.repeat(level.begin[node], fan) + offset
    return labels


def _merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking rows `a` with rows `b`."""
    while True:
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            return labels
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        least = np.minimum(la, lb)
        np.minimum.at(labels, la, least)
        np.minimum.at(labels, lb, least)
        while (jumped := labels[labels] != labels).any():
            labels = np.where(jumped, labels[labels], labels)


def _bucket_links(batches: Iterator[pa.RecordBatch], cfg: SimHashConfig) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, fp) sorted by bucket to link rows (a, b); whole buckets at a time."""

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(fps):
            return
        order = np.lexsort((gray_rank(fps), keys))
        keys, fps = keys[order], fps[order]
        labels = search_links(keys, fps, cfg)
        linked = np.flatnonzero(labels != np.arange(len(fps)))
        if len(linked):
            a, b = fps[linked].view(np.int64), fps[labels[linked]].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    held_keys, held_fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        held_keys = np.r_[held_keys, batch.column(0).to_numpy()]
        held_fps = np.r_[held_fps, batch.column(1).to_numpy().view(np.uint64)]
        if len(held_keys) >= cfg.index_rows:
            cut = int(np.searchsorted(held_keys, held_keys[-1]))
            yield from links(held_keys[:cut], held_fps[:cut])
            held_keys, held_fps = held_keys[cut:], held_fps[cut:]
    yield from links(held_keys, held_fps)


# --------------------------------------------------------------------------- operator


def fingerprint_links(distinct: DataFrame, cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """(a, b) links that connect what `max_bits` connects, from distinct fingerprints `fp`."""
    if not 0 <= cfg.max_bits < cfg.blocks <= 64:
        raise ValueError("blocks must exceed max_bits")
    edges = [64 * i // cfg.blocks for i in range(cfg.blocks + 1)]
    widths = [(1 << (edges[i + 1] - edges[i])) - 1 for i in range(cfg.blocks)]
    masks = []
    for chosen in itertools.combinations(range(cfg.blocks), cfg.blocks - cfg.max_bits):
        mask = sum(widths[i] << edges[i] for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keyed = distinct.select(
        "fp",
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits"))
            for i, m in enumerate(masks)
        ])).alias("key"),
    ).select("fp", F.xxhash64("key.t", "key.bits").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n"))
    # fewer than (fingerprints x tables / bucket_rows) buckets are as large as this
    large = stored(sizes.filter(F.col("n") > cfg.bucket_rows), "large-buckets")
    parts = F.coalesce(F.ceil(F.col("n") / cfg.bucket_rows), F.lit(1)).cast("int")
    dealt = (
        keyed.join(large, "bucket", "left")
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            F.when(F.col("parts") == 1, F.col("bucket"))
            .otherwise(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")))
            .alias("bucket"),
            "fp",
        )
    )
    return (
        dealt.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(lambda batches: _bucket_links(batches, cfg), "a long, b long")
    )


def simhash_components(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", cfg: SimHashConfig = SimHashConfig()
) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Words are lower-cased in A-Z and split at ASCII white space; a null or empty text has no words,
    fingerprint zero, and links like any other. component_id is the smallest id that links reach;
    null ids are ignored there, so it is null only where all ids of a component are null. Repeated
    rows and ids give repeated rows. An empty table gives an empty result.
    """
    prints = fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", cfg)
    prints = stored(prints.select("row.id", "fp"), "fingerprints")
    return _with_components(prints, F.min("id"), cfg).select(
        F.col("id").alias(id_col), hex16(F.col("fp")).alias("fingerprint"),
        F.col("best").alias("component_id"),
    )


def _with_components(prints: DataFrame, best: Column, cfg: SimHashConfig) -> DataFrame:
    """Add `best`, an aggregate over the component of each row of `prints` (fp, ...)."""
    distinct = stored(prints.groupBy("fp").agg(best.alias("best")), "distinct-fingerprints")
    links = stored(fingerprint_links(distinct.select("fp"), cfg), "fingerprint-links")
    labels = stored(component_labels(links), "fingerprint-labels")
    linked = distinct.join(labels, F.col("fp") == F.col("node"))
    found = linked.groupBy("component").agg(F.min("best").alias("least"))
    of_linked = labels.join(found, "component").select("node", "least")
    chosen = distinct.join(of_linked, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("least", "best").alias("best")
    )
    return prints.join(chosen, "fp")


def drop_near_duplicates(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", cfg: SimHashConfig = SimHashConfig()
) -> DataFrame:
    """The rows of `df` that stay: of each component one, that with the smallest id (null last)."""
    prints = fingerprints(df, text_col, cfg).withColumn("uid", F.monotonically_increasing_id())
    prints = stored(prints, "fingerprinted")
    key = F.struct(F.col("id").isNull().alias("none"), "id", "uid")
    narrow = prints.select(F.col("row")[id_col].alias("id"), "uid", "fp")
    marked = _with_components(narrow, F.min(key), cfg)
    dropped = stored(marked.filter(F.col("uid") != F.col("best.uid")).select("uid"), "near-copies")
    return prints.join(dropped, "uid", "left_anti").select("row.*")
