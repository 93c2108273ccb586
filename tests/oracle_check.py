"""Compare catalogue queries with their DuckDB texts.

Usage: python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def kind(name: str) -> str:
    """Spark or DuckDB type name reduced to what must agree."""
    n = name.lower()
    table = {
        "bigint": "int64", "long": "int64", "integer": "int32", "int": "int32", "double": "double",
        "varchar": "string", "string": "string", "boolean": "bool", "timestamp": "timestamp",
        "timestamp_ntz": "timestamp", "date": "date",
    }
    return table.get(n, n)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r))


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else a description of the first difference."""
    df = query(spark, sf_dir)
    spark_kinds = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    duck = {r[0]: kind(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if spark_kinds != duck:
        diff = {k: (spark_kinds.get(k), duck.get(k)) for k in {*spark_kinds, *duck} if spark_kinds.get(k) != duck.get(k)}
        return f"{name}: types differ {diff}"
    if len(got) != len(want):
        return f"{name}: {len(got)} rows against {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{name}: {len(bad)} of {len(got)} rows differ, columns {sorted(columns)}: {bad[0]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, name, queries[name], oracles[name], sf_dir)
                label = "ok" if problem is None else problem
            else:
                problem = None
                label = f"rows {queries[name](spark, sf_dir).count()}"
        except Exception as error:  # report and go on
            problem = label = f"{name}: {type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s  {label}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
