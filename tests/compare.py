"""Run queries on Spark and their SQL on DuckDB and compare all values.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as driver  # noqa: E402
from workload.queries import TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for values in frame.itertuples(index=False, name=None):
        out = []
        for v in values:
            if v is None or (not isinstance(v, (list, str)) and pd.isna(v)):
                out.append("null")
            elif isinstance(v, float):
                out.append(repr(v))
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return sorted(rows)


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """``None`` when equal, else what differs first."""
    a, b = sorted(spark_frame.columns), sorted(sql_frame.columns)
    if a != b:
        return f"columns {a} and {b}"
    kinds = [
        (c, str(spark_frame[c].dtype), str(sql_frame[c].dtype))
        for c in a
        if str(spark_frame[c].dtype) != str(sql_frame[c].dtype)
        and "object" not in (str(spark_frame[c].dtype), str(sql_frame[c].dtype))
        and "datetime" not in str(spark_frame[c].dtype)
    ]
    if kinds:
        return f"types {kinds}"
    if len(spark_frame) != len(sql_frame):
        return f"{len(spark_frame)} and {len(sql_frame)} rows"
    for x, y in zip(normal(spark_frame), normal(sql_frame)):
        if x != y:
            return f"{str(x)[:300]} and {str(y)[:300]}"
    return None


def main() -> int:
    from trove.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = driver.queries(), driver.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            spent = time.time() - start
            result = "rows only"
            if name in sql:
                want = con.execute(sql[name]).df()
                result = difference(got, want) or "equal"
        except Exception as error:  # noqa: BLE001
            spent, got = time.time() - start, []
            result = f"{type(error).__name__}: {str(error)[:600]}"
        bad += result not in ("equal", "rows only")
        print(f"{name:28s} {spent:7.2f}s {len(got):7d} rows  {result}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
