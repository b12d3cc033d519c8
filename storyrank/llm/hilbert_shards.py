"""Hilbert-curve shards: rows that are close in several metadata columns share files.

Every column is cut into cells of about equal numbers of rows, the cells of a row are a point of a
grid, and the points are ordered along the Hilbert curve. Runs of equal length of that order are
the shards, so the value range of each column in a shard is short and files can be skipped by any
of them. All of it is column expressions, aggregates and windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyrank.llm.common import row_of
from storyrank.operators.prefix import running_totals


@dataclass(frozen=True)
class HilbertConfig:
    """`bits`: each column has 2**bits cells; one row per cell comes to the driver."""

    bits: int = 4
    shards: int = 40


def cut_points(df: DataFrame, column: str, total: int, cfg: HilbertConfig) -> list:
    """Smallest value of each cell, ascending; nulls go before all values and take the first cell.

    A cell holds the values with the same share (in 2**bits parts) of rows below them, so equal
    values share a cell and cells are as even as the values allow.
    """
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    below = running_totals(counted, ["value"], ["n"])
    cell = F.floor(F.col("n_before") * F.lit(1 << cfg.bits) / F.lit(max(total, 1)))
    cells = below.filter(F.col("value").isNotNull()).groupBy(cell.alias("cell"))
    rows = cells.agg(F.min("value").alias("least")).orderBy("cell").collect()
    return [(int(r["cell"]), r["least"]) for r in rows]


def cell_of(column: Column, points: list) -> Column:
    """Cell of a value, 0 for null."""
    cell = F.lit(0)
    for number, least in points:
        cell = F.when(column >= F.lit(least), number).otherwise(cell)
    return cell


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Place of a grid point along the Hilbert curve, highest bits first.

    Each level turns the corner the point lies in by the state so far, (entry, direction), counts
    it in Gray order and moves the state on. (Hamilton and Rau-Chaplin, 2008.)
    """
    n = len(cells)
    corners = 1 << n
    gray = [i ^ (i >> 1) for i in range(corners)]
    rank = [0] * corners
    for i, g in enumerate(gray):
        rank[g] = i
    entry = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, corners)]
    ones = [((~i & (i + 1)).bit_length() - 1) % n for i in range(corners)]  # trailing ones
    turn = [0] + [ones[i - 1] if i % 2 == 0 else ones[i] for i in range(1, corners)]
    listed = lambda values: F.array(*[F.lit(v) for v in values])
    # every rotation of every corner, by (rotation, corner)
    full = corners - 1
    right = [((v >> r) | (v << (n - r))) & full for r in range(n) for v in range(corners)]
    left = [((v << r) | (v >> (n - r))) & full for r in range(n) for v in range(corners)]

    def step(state: Column, level: Column) -> Column:
        corner = F.lit(0)
        for i, cell in enumerate(cells):
            bit = F.call_function("shiftright", cell, level).bitwiseAND(F.lit(1))
            corner = corner + bit * F.lit(1 << i)
        seen = corner.bitwiseXOR(state["entry"])
        by = F.pmod(state["turn"] + 1, F.lit(n))
        w = F.get(listed(rank), F.get(listed(right), by * corners + seen))
        return F.struct(
            (state["index"] * corners + w.cast("long")).alias("index"),
            state["entry"].bitwiseXOR(F.get(listed(left), by * corners + F.get(listed(entry), w))).alias("entry"),
            F.pmod(state["turn"] + F.get(listed(turn), w) + 1, F.lit(n)).alias("turn"),
        )

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("entry"), F.lit(0).alias("turn"))
    levels = F.array(*[F.lit(level) for level in reversed(range(bits))])
    return F.aggregate(levels, start, step)["index"]


def hilbert_shards(
    df: DataFrame, columns: list[str], tie: list[str], cfg: HilbertConfig = HilbertConfig()
) -> DataFrame:
    """(row, hilbert, shard, slot): shards of row counts at most one apart, slots from 0 in each.

    The order is the curve index, then the columns of `tie`; rows that agree in all of these take
    some order among them. Null metadata counts as the smallest value. All columns of `df` are kept
    in `row`. An empty table gives an empty result.
    """
    wide = df.select(
        row_of(df).alias("row"),
        *[F.col(f"`{c}`").alias(f"_dim{i}") for i, c in enumerate(columns)],
        *[F.col(f"`{c}`").alias(f"_tie{i}") for i, c in enumerate(tie)],
    )
    dims = [f"_dim{i}" for i in range(len(columns))]
    total = df.count()
    cells = [cell_of(F.col(d), cut_points(wide.select(d), d, total, cfg)) for d in dims]
    # the cells are one step of the plan, so that each is worked out once for a row
    placed = wide.withColumns({f"_cell{i}": c for i, c in enumerate(cells)}).withColumn(
        "hilbert", hilbert_index([F.col(f"_cell{i}") for i in range(len(cells))], cfg.bits)
    )
    narrow = placed.select("row", "hilbert", *[f"_tie{i}" for i in range(len(tie))], F.lit(1).cast("long").alias("one"))
    ranked = running_totals(narrow, ["hilbert", *[f"_tie{i}" for i in range(len(tie))]], ["one"])
    return cut_runs(ranked, F.col("one_before"), total, cfg.shards).select("row", "hilbert", "shard", "slot")


def cut_runs(ranked: DataFrame, rank: Column, total: int, shards: int) -> DataFrame:
    """Add shard and slot: runs of `total` ranks of equal length."""
    n = F.lit(max(total, 1)).cast("long")
    shard = F.floor(rank * shards / n)
    # floor of an exact quotient: the ranks are whole numbers far below 2**53 / shards
    first = F.ceil(shard * n / shards)
    return ranked.select("*", shard.cast("int").alias("shard"), (rank - first).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str, shards: int) -> None:
    """Write the rows of `hilbert_shards` as one folder per shard, in slot order."""
    rows = sharded.select("row.*", "shard", "slot")
    ordered = rows.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot")
    ordered.drop("slot").write.mode("overwrite").partitionBy("shard").parquet(path)
