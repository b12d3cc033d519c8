"""Top rows per group without funnelling a hot group through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(
    df: DataFrame,
    group: str,
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    spread_on: str | None = None,
    salts: int = 32,
) -> DataFrame:
    """First `k` rows of each group in `order`, numbered from 1 in column `rank`.

    With `spread_on` a first round keeps the best `k` of each slice of a group; the second round
    then sees at most `salts * k` rows per group, however large the group is. A row among the
    best `k` of its group is among the best `k` of its slice, so the result is exact.
    """
    if spread_on is not None:
        slices = df.withColumn("_slice", F.pmod(F.xxhash64(spread_on), F.lit(salts)))
        best = F.row_number().over(Window.partitionBy(group, "_slice").orderBy(*order))
        df = slices.withColumn("_best", best).filter(F.col("_best") <= k).drop("_slice", "_best")
    position = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn(rank, position).filter(F.col(rank) <= k)
