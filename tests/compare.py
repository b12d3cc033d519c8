"""Compare registered queries with their SQL oracles on the driver tables."""

from __future__ import annotations

import glob
import math
import os
import sys
import tempfile
import time

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def table(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=repr)


# engine types that count as the same
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def difference(spark_df, con, sql: str) -> str | None:
    """None when both results are the same table, else a short account of the first gap."""
    mine_types = {name: TYPES.get(kind, kind) for name, kind in spark_df.dtypes}
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    their_types = {row[0]: row[1] for row in described}
    if mine_types != their_types:
        return f"types {mine_types} against {their_types}"
    mine = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    theirs = table([d[0] for d in result.description], result.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} against {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} against {len(theirs[1])}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            return f"{str(a)[:300]} against {str(b)[:300]}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="storyrank-compare-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = duck(sf_dir), entry.oracle_sql()
    names = sys.argv[1:] or list(entry.queries())
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            if name in oracles:
                state = difference(df, con, oracles[name]) or "same"
            else:
                state = f"{len(df.collect())} rows"
        except Exception as error:  # report and go on with the next query
            state = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        print(f"{name}: {state} ({time.time() - start:.1f}s)", flush=True)


if __name__ == "__main__":
    main()
