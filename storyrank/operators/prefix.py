"""Running sums over ordered rows without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyrank.sources.scratch import stored


def running_totals(
    df: DataFrame, order: Sequence[str], amounts: Sequence[str], group: str | None = None
) -> DataFrame:
    """Add `<amount>_before`: sum of each long column `amount` over all earlier rows.

    Rows are dealt in ranges of (group, order), so that no group or range lands in one task; each
    range adds up its own rows and starts from the totals of the ranges before it. With `group`
    the sums restart for each of its values. The columns of `order` should tell rows apart: rows
    that tie take some order. Only a (range, group) table, one row per range and one more per
    group at most, is joined back.
    """
    keys = [group] if group else []
    narrow = (
        df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    )
    narrow = stored(narrow, "ranges")
    totals = narrow.groupBy("_range", *keys).agg(*[F.sum(a).alias(f"_sum_{a}") for a in amounts])
    before = W.partitionBy(*[F.col(k) for k in keys]).orderBy("_range") if keys else W.orderBy("_range")
    earlier = before.rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(
        F.col("_range").alias("_base_range"),
        *[F.col(k).alias(f"_base_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_sum_{a}").over(earlier), F.lit(0)).alias(f"_base_{a}") for a in amounts],
    )
    own = W.partitionBy("_range", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = narrow.select(
        "*", *[F.coalesce(F.sum(a).over(own), F.lit(0)).alias(f"{a}_before") for a in amounts]
    )
    same = F.col("_range") == F.col("_base_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_base_{k}"))
    joined = summed.join(bases, same)
    return joined.select(
        *df.columns, *[(F.col(f"{a}_before") + F.col(f"_base_{a}")).alias(f"{a}_before") for a in amounts]
    )
