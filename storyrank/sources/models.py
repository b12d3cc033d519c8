"""Fitted models as versioned folders of tables.

A version is a folder of Parquet tables and a manifest that names them, written last; a version
without a manifest does not exist for readers, so a write that stops halfway leaves the one before
in place. What is loaded are tables and numbers, from which models are put together again: terms and
basis of LSA, centres, word vectors, topics.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from storyrank.operators.kmeans import Centres
from storyrank.sources import files

FORMAT = 1


@dataclass(frozen=True)
class Saved:
    version: int
    tables: dict[str, DataFrame]
    facts: dict


def _versions(spark: SparkSession, path: str) -> list[int]:
    names = files.children(spark, path)
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())


def _complete(spark: SparkSession, path: str, version: int) -> bool:
    return files.exists(spark, f"{path}/v{version}/manifest/_SUCCESS")


def save_model(spark: SparkSession, path: str, tables: dict[str, DataFrame], facts: dict | None = None) -> int:
    """Write a new version and return its number. `facts`: small values, kept in the manifest."""
    path = path.rstrip("/")
    # a number that a failed attempt has used is not used again
    version = max(_versions(spark, path), default=0) + 1
    for name, table in tables.items():
        table.write.parquet(f"{path}/v{version}/{name}")
    manifest = {"format": FORMAT, "tables": sorted(tables), "facts": facts or {}}
    line = spark.createDataFrame([(json.dumps(manifest),)], "value string")
    line.coalesce(1).write.text(f"{path}/v{version}/manifest")
    return version


def load_model(spark: SparkSession, path: str, version: int | None = None) -> Saved:
    """The newest complete version, or the given one."""
    path = path.rstrip("/")
    known = [v for v in _versions(spark, path) if _complete(spark, path, v)]
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no complete version {'' if version is None else version} of a model in {path}")
    version = known[-1] if version is None else version
    manifest = json.loads(spark.read.text(f"{path}/v{version}/manifest").first()["value"])
    if manifest["format"] != FORMAT:
        raise ValueError(f"format {manifest['format']} of {path} is not known")
    tables = {name: spark.read.parquet(f"{path}/v{version}/{name}") for name in manifest["tables"]}
    return Saved(version, tables, manifest["facts"])


def save_centres(spark: SparkSession, path: str, found: Centres) -> int:
    facts = {"rounds": found.rounds, "cost": found.cost}
    return save_model(spark, path, {"centres": found.frame(spark)}, facts)


def load_centres(spark: SparkSession, path: str) -> Centres:
    """As fitted; there are as many rows as clusters."""
    saved = load_model(spark, path)
    rows = saved.tables["centres"].orderBy("cluster").collect()
    return Centres(np.array([r["centre"] for r in rows]), saved.facts["rounds"], saved.facts["cost"])
