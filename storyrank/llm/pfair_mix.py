"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of equal size in bytes. With weight a of W, its block j may not run
before slot floor(j W / a) and must have run by slot ceil((j + 1) W / a); of the blocks that may
run, the one with the earliest deadline does. The schedule repeats after W slots, in which each
source runs a blocks, and no source is ever a whole block from its share. So the schedule of one
period is worked out once, and every block finds its slot by arithmetic. When a source has no
block left its slots are skipped and the others go on by their weights; no row is dropped.
(Baruah et al., 1996.)

Given weights are scheduled as they are, without rounding, as long as one period of them is short
enough to be worked out (`MixConfig.exact_slots`); without given weights the target is the square
root of each source's size, in whole shares of `MixConfig.period`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyrank.llm.common import row_of
from storyrank.operators.prefix import running_totals
from storyrank.sources.scratch import stored


@dataclass(frozen=True)
class MixConfig:
    """`period`: about how many slots a period has where weights are rounded to whole shares of it, one
    slot at least each. `exact_slots`, `exact_cells`: given weights are kept as they are while their sum
    over their common divisor, and that times the sources, does not pass these. `block_bytes`: size
    of a block."""

    period: int = 240
    exact_slots: int = 8_192
    exact_cells: int = 2_000_000
    block_bytes: int = 65_536


def root_weights(sizes: DataFrame) -> DataFrame:
    """(source, weight) from (source, bytes): weight grows with the square root of the size."""
    return sizes.select("source", F.greatest(F.rint(F.sqrt("bytes")), F.lit(1)).cast("long").alias("weight"))


def whole_shares(weights: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """(sources, shares): one row of arrays by ascending source, shares whole and positive."""
    listed = weights.groupBy().agg(F.sort_array(F.collect_list(F.struct("source", "weight"))).alias("all"))
    total = F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x["weight"])
    share = lambda x: F.greatest(
        F.floor((F.lit(2 * cfg.period) * x["weight"] + F.col("total")) / (2 * F.col("total"))), F.lit(1)
    ).cast("int")
    return listed.withColumn("total", F.greatest(total, F.lit(1))).select(
        F.transform("all", lambda x: x["source"]).alias("sources"), F.transform("all", share).alias("shares")
    )


def _divisor(a: Column, b: Column) -> Column:
    """Greatest common divisor of two whole numbers below 2^63, by Euclid."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(
        s["b"] > 0, F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))
    ).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def exact_shares(weights: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """(sources, shares): the given weights themselves, divided by what they have in common.

    Weights whose period is too long to be worked out become whole shares of up to 4,096 slots. A
    weight below one counts as one.
    """
    positive = weights.withColumn("weight", F.greatest("weight", F.lit(1)))
    listed = positive.groupBy().agg(
        F.sort_array(F.collect_list(F.struct("source", "weight"))).alias("all"),
        F.sum(F.col("weight").cast("double")).alias("total"),
    )
    divisor = F.aggregate("all", F.lit(0).cast("long"), lambda g, x: _divisor(x["weight"], g))
    row = listed.withColumn("divisor", F.greatest(divisor, F.lit(1)))
    slots, sources = F.col("total") / F.col("divisor"), F.greatest(F.size("all"), F.lit(1))
    fits = (slots <= cfg.exact_slots) & (slots * sources <= cfg.exact_cells)
    exact = F.transform("all", lambda x: F.when(fits, F.floor(x["weight"] / F.col("divisor"))).otherwise(1).cast("int"))
    longer = F.least(F.lit(4_096), F.greatest(F.lit(cfg.period), F.floor(cfg.exact_cells / sources)))
    share = F.transform(
        "all", lambda x: F.greatest(F.rint(longer * (x["weight"] / F.col("total"))), F.lit(1.0)).cast("int")
    )
    return row.select(
        F.transform("all", lambda x: x["source"]).alias("sources"),
        F.when(fits, exact).otherwise(share).alias("shares"),
    )


def period_schedule(shares: DataFrame) -> DataFrame:
    """(source, nth, slot, share, period, release, deadline): one row per slot of a period.

    `shares`: one row of arrays (sources, shares). The fold goes over the slots in time and keeps
    how many blocks of each source have run.
    """
    period = F.aggregate("shares", F.lit(0), lambda s, x: s + x)
    one = shares.withColumn("period", period)

    def run(state: Column, slot: Column) -> Column:
        # deadline of the next block of every source, beyond all slots when it may not run yet
        deadlines = F.transform("shares", lambda a, i: _deadline(F.get(state["done"], i), a, F.col("period"), slot))
        pick = (F.array_position(deadlines, F.array_min(deadlines)) - 1).cast("int")
        done = F.transform(state["done"], lambda d, i: d + (i == pick).cast("int"))
        picks = F.concat(state["picks"], F.array(F.struct(pick.alias("i"), F.get(state["done"], pick).alias("nth"))))
        return F.struct(done.alias("done"), picks.alias("picks"))

    start = F.struct(
        F.transform("shares", lambda _: F.lit(0)).alias("done"),
        F.slice(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("nth"))), 1, 0).alias("picks"),
    )
    slots = F.sequence(F.lit(0), F.col("period") - 1)
    picked = one.filter(F.col("period") > 0).select(
        "sources", "shares", "period", F.posexplode(F.aggregate(slots, start, run)["picks"]).alias("slot", "p")
    )
    share = F.get("shares", F.col("p.i"))
    return picked.select(
        F.get("sources", F.col("p.i")).alias("source"),
        F.col("p.nth").alias("nth"),
        "slot",
        share.alias("share"),
        "period",
        F.floor(F.col("p.nth") * F.col("period") / share).cast("int").alias("release"),
        F.ceil((F.col("p.nth") + 1) * F.col("period") / share).cast("int").alias("deadline"),
    )


def _deadline(done: Column, share: Column, period: Column, slot: Column) -> Column:
    ready = (done < share) & (F.floor(done * period / share) <= slot)
    return F.when(ready, F.ceil((done + 1) * period / share)).otherwise(F.lit(2**62))


def mix_sources(
    df: DataFrame,
    weights: DataFrame | None = None,
    source_col: str = "source",
    order: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    cfg: MixConfig = MixConfig(),
) -> DataFrame:
    """One row per row of `df`: the columns of `order`, source, size, block, slot, position.

    See `mixed_rows` for the rows themselves in mixed order. Rows of a source follow `order`; a row belongs to the block in which its first byte lies, its size being
    the UTF-8 bytes of its text plus one. Position numbers all rows by slot from 0 without gaps. A
    null source is a source of its own, a source without a given weight has weight 1, a weight
    without rows takes part in the schedule and its slots are skipped. Rows that tie in `order`
    take some order. An empty table gives an empty result.
    """
    rows = stored(_keyed(df, source_col, order, text_col).drop("row"), "mix-rows")
    placed = _placed(rows, weights, cfg)
    names = {f"_order{i}": c for i, c in enumerate(order)}
    return placed.select(
        *[F.col(k).alias(c) for k, c in names.items()], "source", "size", "block", "slot", "position"
    )


def mixed_rows(
    df: DataFrame,
    weights: DataFrame | None = None,
    source_col: str = "source",
    order: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    cfg: MixConfig = MixConfig(),
) -> DataFrame:
    """All rows of `df`, columns as they were, in mixed order: partition after partition."""
    rows = stored(_keyed(df, source_col, order, text_col), "mix-rows")
    placed = _placed(rows.drop("row"), weights, cfg).select("uid", "position")
    # both sides grow with the input, so the plan is the same at every size
    joined = rows.select("uid", "row").hint("merge").join(placed, "uid")
    return joined.repartitionByRange("position").sortWithinPartitions("position").select("row.*")


def _keyed(df: DataFrame, source_col: str, order: tuple[str, ...], text_col: str) -> DataFrame:
    return df.select(
        row_of(df).alias("row"),
        F.col(source_col).cast("string").alias("source"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        *[F.col(f"`{c}`").alias(f"_order{i}") for i, c in enumerate(order)],
        F.monotonically_increasing_id().alias("uid"),
    )


def _placed(rows: DataFrame, weights: DataFrame | None, cfg: MixConfig) -> DataFrame:
    order = [c for c in rows.columns if c.startswith("_order")]
    narrow = rows.select("uid", "source", "size", *order)
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("bytes"))
    given = weights
    if given is None:
        weights = root_weights(sizes)
    else:
        named = given.select(F.col("source").alias("_source"), F.col("weight").cast("long"))
        weights = sizes.join(named, F.col("source").eqNullSafe(F.col("_source")), "full_outer").select(
            F.coalesce("source", "_source").alias("source"), F.coalesce("weight", F.lit(1)).alias("weight")
        )
    shares = whole_shares(weights, cfg) if given is None else exact_shares(weights, cfg)
    schedule = stored(period_schedule(shares), "schedule")
    per_source = schedule.select("source", "share", "period").distinct()
    block = F.floor(F.col("size_before") / cfg.block_bytes).cast("long")
    blocks = running_totals(narrow, [*order, "uid"], ["size"], group="source").withColumn("block", block)

    # both tables have a row per slot or less: `period` plus one for each source at most
    same = F.col("b.source").eqNullSafe(F.col("s.source"))
    known = blocks.alias("b").join(F.broadcast(per_source.alias("s")), same).select(
        "b.*", "share", "period", F.pmod("b.block", F.col("share").cast("long")).cast("int").alias("nth")
    )
    same = F.col("k.source").eqNullSafe(F.col("p.source")) & (F.col("k.nth") == F.col("p.nth"))
    timed = known.alias("k").join(
        F.broadcast(schedule.select("source", "nth", F.col("slot").alias("first_slot")).alias("p")), same
    ).select(
        "k.uid", *[f"k.{c}" for c in order], "k.source", "k.size", "k.size_before", "k.block",
        (F.floor(F.col("k.block") / F.col("k.share")) * F.col("k.period") + F.col("first_slot")).cast("long").alias("slot"),
        F.lit(1).cast("long").alias("one"),
    )
    ranked = running_totals(timed, ["slot", "size_before", "uid"], ["one"])
    return ranked.select(
        "uid", *order, "source", "size", "block", "slot", F.col("one_before").alias("position")
    )
