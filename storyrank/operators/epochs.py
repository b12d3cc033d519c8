"""Another order of the rows for each training epoch, without a random column or a global sort.

Row numbers 0..n-1 go through a keyed bijection: a Feistel network over pairs (l, r) of a x b >= n
numbers, of which fewer than a are too many; a number that lands outside goes through again until it
is inside (cycle walking; Black and Rogaway, 2002). The place of a row follows from its number, the
seed and the epoch alone, so every epoch can be repeated, in part too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyrank.operators.prefix import running_totals

ROUNDS = 4
WALK = 24


def shape(n: int) -> tuple[int, int]:
    a = max(math.isqrt(max(n - 1, 0)) + 1, 1)
    return a, max(-(-n // a), 1)


def _mixed(value: Column, salt: Column) -> Column:
    """32 bits that depend on a number and a text."""
    text = F.md5(F.concat_ws(":", salt, value.cast("string")))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("long")


def _once(x: Column, a: int, b: int, salt: Column) -> Column:
    """One pass of the network over a number below a x b."""

    def turn(pair: Column, step: Column) -> Column:
        named = F.concat_ws(":", salt, step.cast("string"))
        left = (pair["l"] + _mixed(pair["r"], F.concat(named, F.lit("l")))) % a
        right = F.transform(F.array(left), lambda l: (pair["r"] + _mixed(l, F.concat(named, F.lit("r")))) % b)
        return F.struct(left.alias("l"), F.get(right, F.lit(0)).alias("r"))

    start = F.struct(F.floor(x / b).alias("l"), (x % b).alias("r"))
    steps = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(steps, start, turn, lambda pair: pair["l"] * b + pair["r"])


def place(number: Column, n: int, seed: int, epoch: Column) -> Column:
    """Place of row `number` of `n` in an epoch; a bijection of 0..n-1."""
    a, b = shape(n)
    salt = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"))
    first = _once(number.cast("long"), a, b, salt)
    # a walk leaves the numbers outside after as many steps as there are; long before that as a rule
    walk = F.sequence(F.lit(1), F.lit(min(a * b - n, WALK)))
    if a * b == n:
        return first
    end = F.aggregate(walk, first, lambda x, _: F.when(x < n, x).otherwise(_once(x, a, b, salt)))
    return F.when(end < n, end).otherwise(F.raise_error(F.lit("a walk did not end")).cast("long"))


def epoch_order(rows: DataFrame, order: Sequence[str], epochs: Sequence[int], seed: int = 42) -> DataFrame:
    """`rows` once for each epoch, with `epoch` and `place` 0..n-1 in it.

    `order` tells rows apart and gives them their numbers, which all epochs share.
    """
    ones = rows.withColumn("_one", F.lit(1).cast("long"))
    numbered = running_totals(ones, order, ["_one"])
    n = rows.count()
    each = numbered.withColumn("epoch", F.explode(F.array(*[F.lit(int(e)) for e in epochs])))
    placed = each.withColumn("place", place(F.col("_one_before"), n, seed, F.col("epoch")))
    return placed.drop("_one", "_one_before")


def in_epoch(rows: DataFrame, epoch: int, order: Sequence[str], seed: int = 42) -> DataFrame:
    """The rows dealt and sorted by their place in one epoch, to be read in order of partitions."""
    placed = epoch_order(rows, order, [epoch], seed)
    return placed.repartitionByRange("place").sortWithinPartitions("place").drop("epoch", "place")
