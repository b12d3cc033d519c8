"""Packing of token pieces into sequences by a configuration linear program.

The lengths of the pieces are counted; their histogram has at most `capacity` entries however
large the input is. Over it the linear program "fewest sequences so that each length is covered"
has a column for every way to fill a sequence. Multiplicative weights solve it: lengths that are
covered least are worth most, and a knapsack dynamic program finds the filling of highest worth.
Rounding keeps half of each fractional count, rounded down, of the fillings without a gap; what is
left is placed best fit, longest first, by groups of equal lengths. (Rounding all of it down leaves
pieces that fit badly: more sequences than best fit alone.) The result is a short table of runs, by
which each piece finds its own place. Rows in a given order are packed window by window, so that
their sequences keep it; the program is solved once, for all windows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyrank.llm.common import BATCH_BYTES, BATCH_ROWS, small_batches
from storyrank.llm.tokens import ENCODED_TOGETHER, TokenizerSpec, encoder
from storyrank.operators.prefix import running_totals
from storyrank.sources.scratch import stored


@dataclass(frozen=True)
class PackConfig:
    """`step`: share of a length that one round covers at most; `rate`: exponent of the weights;
    `keep`: share of a filling's fractional number that rounding keeps; `window`: pieces that are
    packed together when sequences keep an order."""

    capacity: int = 1024
    step: float = 0.25
    rate: float = 1.0
    keep: float = 0.5
    window: int = 8_192


# --------------------------------------------------------------------------- the plan


@dataclass
class Plan:
    """Runs (length, first rank, pieces, pieces per sequence, first sequence, offset)."""

    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    bound: float = 0.0


def best_filling(worth: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """Filling of highest worth; `worth[l]` is what a piece of length l is worth."""
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        options = worth[1 : room + 1] + best[room - 1 :: -1] if room > 1 else worth[1:2] + best[:1]
        pick = int(options.argmax())
        if options[pick] > best[room - 1]:
            best[room], last[room] = options[pick], pick + 1
        else:
            best[room] = best[room - 1]
    filling: dict[int, int] = defaultdict(int)
    room = capacity
    while room > 0:
        if last[room]:
            filling[int(last[room])] += 1
            room -= int(last[room])
        else:
            room -= 1
    return float(best[capacity]), dict(filling)


def fractional(counts: np.ndarray, cfg: PackConfig) -> tuple[dict[tuple, float], float]:
    """Fillings with their fractional numbers that cover `counts` exactly, and a lower bound.

    `counts[l]` pieces have length l. A length is worth its size times a weight that falls
    exponentially with the share of it that is covered; a covered length is worth nothing. Each
    round takes the filling of highest worth, as often as covers `step` of its scarcest length.
    The weights are a feasible dual too: their worth of all pieces over the worth of the best
    filling bounds every packing from below.
    """
    lengths = np.flatnonzero(counts)
    demand = counts[lengths].astype(float)
    left = demand.copy()
    place = {int(n): i for i, n in enumerate(lengths)}
    used: dict[tuple, float] = defaultdict(float)
    bound = float((lengths * demand).sum()) / cfg.capacity
    worth = np.zeros(cfg.capacity + 1)
    while left.any():
        share = left / demand
        price = np.where(left > 0, lengths * np.exp(cfg.rate * (share - share.max())), 0.0)
        worth[:] = 0.0
        worth[lengths] = price
        value, filling = best_filling(worth, cfg.capacity)
        bound = max(bound, float((price * demand).sum()) / value)
        amount = min(
            min(max(cfg.step * demand[place[n]], 1.0), left[place[n]]) / k for n, k in filling.items()
        )
        used[tuple(sorted(filling.items()))] += amount
        for n, k in filling.items():
            i = place[n]
            left[i] = left[i] - k * amount if left[i] - k * amount > 1e-6 * demand[i] else 0.0
    return used, bound


def whole_fillings(counts: np.ndarray, cfg: PackConfig) -> tuple[list[tuple[tuple, int]], float]:
    """((length, pieces)..., sequences) of the rounded program, and its lower bound; `counts` by
    length, those of full length left out."""
    if not counts.any():
        return [], 0.0
    fillings, bound = fractional(counts, cfg)
    full = [
        (f, int(cfg.keep * amount)) for f, amount in fillings.items()
        if sum(n * k for n, k in f) == cfg.capacity and cfg.keep * amount >= 1
    ]
    return sorted(full, key=lambda x: (-x[1], x[0])), bound


def make_plan(counts: np.ndarray, cfg: PackConfig, fillings: list[tuple[tuple, int]] | None = None) -> Plan:
    """Runs that place every piece counted in `counts` (index: length).

    `fillings` are used as often as they say, as far as there are pieces; those of the rounded
    program unless given.
    """
    plan = Plan()
    left = counts.astype(np.int64).copy()
    placed = np.zeros_like(left)
    full = int(left[cfg.capacity])
    left[cfg.capacity] = 0
    if fillings is None:
        fillings, plan.bound = whole_fillings(left, cfg)
    for filling, wanted in fillings:
        copies = min([wanted, *[int(left[n]) // k for n, k in filling]])
        if copies:
            offset = 0
            for n, k in filling:
                plan.runs.append((n, int(placed[n]), copies * k, k, plan.sequences, offset))
                placed[n], left[n] = placed[n] + copies * k, left[n] - copies * k
                offset += n * k
            plan.sequences += copies
    _best_fit(plan, left, placed, cfg.capacity)
    if full:
        plan.runs.append((cfg.capacity, 0, full, 1, plan.sequences, 0))
        plan.sequences += full
    plan.bound += full
    return plan


def _best_fit(plan: Plan, left: np.ndarray, placed: np.ndarray, capacity: int) -> None:
    """Place what is left, longest first, where least room stays; equal sequences go as groups."""
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, number)
    for n in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[n])
        while todo:
            fitting = min((r for r, groups in room.items() if r >= n and groups), default=None)
            if fitting is None:
                per = capacity // n
                opened = -(-todo // per)
                room[capacity].append((plan.sequences, opened))
                plan.sequences += opened
                continue
            first, number = room[fitting].pop()
            per = min(fitting // n, todo)
            whole = min(number, todo // per)
            count = whole * per
            plan.runs.append((n, int(placed[n]), count, per, first, capacity - fitting))
            placed[n] += count
            todo -= count
            room[fitting - per * n].append((first, whole))
            if number > whole:
                room[fitting].append((first + whole, number - whole))


# ------------------------------------------------------------------------- the pieces


def token_pieces(
    df: DataFrame,
    tokenizer: TokenizerSpec,
    end_id: int,
    capacity: int,
    text_col: str = "text",
    id_col: str = "doc_id",
    order: Sequence[str] = (),
    together: tuple[int, str] = (BATCH_ROWS, BATCH_BYTES),
) -> DataFrame:
    """Stored pieces of all texts: doc_id, piece, start, length, ids_crc32, part, nth.

    `part` is the task that made a piece and `nth` its number among those of its length there. The
    columns of `order` follow as _order0, _order1 and so on. Batches to encode have at most so many
    rows and bytes as `together` says.
    """
    small_batches(df.sparkSession, *together)
    shipped = tokenizer.ship(df.sparkSession)
    places = [F.col(c).alias(f"_order{i}") for i, c in enumerate(order)]
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *places)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long"
    )
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *rows.columns[2:]]
    schema += "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns[2:])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shipped).encode
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            origin, pieces, starts, lengths, crcs, nths = [], [], [], [], [], []
            found, begins = encode(batch.column(1))
            for i, (first, last) in enumerate(zip(begins, begins[1:])):
                ids = np.append(found[first:last], end_id).astype("<u4")
                start, stop = 0, len(ids) % capacity or capacity
                piece = 0
                while start < len(ids):
                    origin.append(i)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(stop - start)
                    crcs.append(zlib.crc32(ids[start:stop].tobytes()))
                    nths.append(int(seen[stop - start]))
                    seen[stop - start] += 1
                    piece, start, stop = piece + 1, stop, stop + capacity
            origins = pa.array(origin, pa.int64())
            docs = batch.column(0).take(origins)
            others = [
                pa.array(pieces, pa.int32()),
                *[pa.array(v, pa.int64()) for v in (starts, lengths, crcs)],
                pa.array([part] * len(origin), pa.int32()),
                pa.array(nths, pa.int64()),
                *[c.take(origins) for c in batch.columns[2:]],
            ]
            yield pa.RecordBatch.from_arrays([docs, *others], names)

    return stored(rows.mapInArrow(cut, schema), "pieces")


def place_pieces(pieces: DataFrame, cfg: PackConfig = PackConfig()) -> DataFrame:
    """Add sequence_id and offset to stored `pieces` (..., length, part, nth)."""
    held = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    plan = make_plan(_counts(held, cfg), cfg)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 6)
    shipped = pieces.sparkSession.sparkContext.broadcast(runs)

    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = held.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def placed(length: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, offset = _in_runs(shipped.value, length.to_numpy(), rank.to_numpy())
        return pa.StructArray.from_arrays(
            [pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"]
        )

    found = ranked.withColumn("place", placed("length", "rank"))
    return found.select(
        *[c for c in pieces.columns if c not in ("part", "nth")], "place.sequence_id", "place.offset"
    )


def _counts(held: DataFrame, cfg: PackConfig) -> np.ndarray:
    """Number of pieces by length, from (length, n); at most `capacity` rows come to the driver."""
    counts = np.zeros(cfg.capacity + 1, np.int64)
    for row in held.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    return counts


SPAN = 1 << 50  # above any number of pieces


def _in_runs(table: np.ndarray, n: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces of length `n` and rank `r` by the sorted runs of a plan."""
    key = table[:, 0] * SPAN + table[:, 1]
    run = table[np.searchsorted(key, n * SPAN + r, side="right") - 1]
    nth = r - run[:, 1]
    return run[:, 4] + nth // run[:, 3], run[:, 5] + nth % run[:, 3] * n


def pack_documents(
    df: DataFrame,
    tokenizer: TokenizerSpec,
    end_id: int,
    cfg: PackConfig = PackConfig(),
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """Pieces of all texts with their places: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    A document is its ids and the end id; a null or empty text is the end id alone. Only documents
    longer than the capacity are cut, the first piece being the shorter one. Null and repeated
    document ids are kept as they are; an empty table gives an empty result. Sequences are numbered
    without gaps, those filled by one piece come last.
    """
    pieces = token_pieces(df, tokenizer, end_id, cfg.capacity, text_col, id_col, together=ENCODED_TOGETHER)
    return place_pieces(pieces, cfg)


def pack_in_order(
    df: DataFrame,
    tokenizer: TokenizerSpec,
    end_id: int,
    order: Sequence[str],
    cfg: PackConfig = PackConfig(),
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """As `pack_documents`, with sequences in the order of their documents.

    Each `window` consecutive pieces are packed by themselves, so a sequence holds pieces of one
    window only; sequences are numbered by windows, then by their first piece in `order`. The
    fillings of the program over all lengths are dealt to the windows in turn. The columns of
    `order` should tell rows apart: rows that tie take some order.
    """
    pieces = token_pieces(df, tokenizer, end_id, cfg.capacity, text_col, id_col, order).drop("part", "nth")
    places = [c for c in pieces.columns if c.startswith("_order")]
    numbered = running_totals(pieces.withColumn("rank", F.lit(1).cast("long")), [*places, "piece"], ["rank"])
    ranked = numbered.drop("rank", *places).withColumn(
        "window", F.floor(F.col("rank_before") / cfg.window).cast("long")
    )
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", "window"]
    counts = _counts(pieces.groupBy("length").agg(F.count("*").alias("n")), cfg)
    windows = max(-(-int(counts.sum()) // cfg.window), 1)
    counts[cfg.capacity] = 0
    shipped = pieces.sparkSession.sparkContext.broadcast(whole_fillings(counts, cfg)[0])

    def placed(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank_before")
        n = table["length"].to_numpy()
        w = table["window"][0].as_py()
        own = [(f, copies * (w + 1) // windows - copies * w // windows) for f, copies in shipped.value]
        plan = make_plan(np.bincount(n, minlength=cfg.capacity + 1), cfg, own)
        runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 6)
        by_length = np.argsort(n, kind="stable")
        nth = np.empty(len(n), np.int64)  # rank among the pieces of its length
        nth[by_length] = np.arange(len(n)) - np.searchsorted(n[by_length], n[by_length])
        sequence, offset = _in_runs(runs, n, nth)
        _, firsts, own = np.unique(sequence, return_index=True, return_inverse=True)
        number = np.argsort(np.argsort(firsts))[own]
        out = table.select(kept)
        return out.append_column("nth", pa.array(number)).append_column("offset", pa.array(offset))

    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, window long, nth long, offset long"
    )
    packed = stored(ranked.groupBy("window").applyInArrow(placed, schema), "packed")
    totals = packed.groupBy("window").agg((F.max("nth") + 1).alias("n"))  # a row per window
    bases = running_totals(totals, ["window"], ["n"]).select("window", F.col("n_before").alias("base"))
    return packed.join(bases, "window").select(
        *kept[:-1], (F.col("base") + F.col("nth")).alias("sequence_id"), "offset"
    )
