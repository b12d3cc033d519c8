"""Equality look-ups of many rows (facts) in a table of unique keys.

A table whose row count is proven small is broadcast. With a larger one the keys that many facts
share are split off: there are few of them by counting, so their table rows are broadcast and
their facts never move. What remains is joined by shuffle, and none of its keys is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyrank.config import LookupConfig
from storyrank.sources.scratch import stored


def lookup(
    facts: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    cfg: LookupConfig = LookupConfig(),
    how: str = "inner",
    small: bool | None = None,
    heat: DataFrame | None = None,
) -> DataFrame:
    """Join `facts` to `table`, unique on `keys`; `how` is `inner` or `left`.

    Pass `small` when the size is already known; otherwise the table is written to scratch, so
    that counting it and joining it compute it once. Pass `heat`, a stored table (keys, n) of
    facts per key, when it is at hand.
    """
    keys = list(keys)
    if small is None:
        table = stored(table, "lookup")
        small = table.count() <= cfg.max_broadcast_rows
    if small:
        return facts.join(F.broadcast(table), keys, how)
    return split_join(facts, table, keys, cfg.max_broadcast_rows, how, heat)


def split_join(
    facts: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    max_hot: int,
    how: str = "inner",
    heat: DataFrame | None = None,
) -> DataFrame:
    """Broadcast join for the hot keys of `facts`, shuffle join for all others.

    A key is hot when it holds more than one `max_hot`-th of all facts, so fewer than `max_hot`
    keys are hot and no other key can overload a task.
    """
    keys = list(keys)
    if heat is None:
        heat = stored(facts.groupBy(*keys).agg(F.count("*").alias("n")), "heat")
    total = heat.agg(F.sum("n")).first()[0] or 0
    hot = stored(heat.filter(F.col("n") > total / max(max_hot, 1)).select(*keys), "hot-keys")
    hot_rows = table.join(F.broadcast(hot), keys, "left_semi")
    if how == "left":
        hot_rows = hot.join(F.broadcast(hot_rows), keys, "left")
    still = facts.join(F.broadcast(hot_rows), keys)
    moved = facts.join(F.broadcast(hot), keys, "left_anti").join(table, keys, how)
    return still.unionByName(moved)
