"""Compare registered queries with their SQL on the test tables."""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

DATA = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _kind(name: str) -> str:
    name = name.upper()
    return {"STRING": "VARCHAR", "INT": "INTEGER", "LONG": "BIGINT"}.get(name, name)


def _cell(value):
    return round(value, 9) if isinstance(value, float) else value


def difference(result: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both have the same columns, types and rows; else what differs."""
    rows = con.execute(sql)
    theirs = {d[0]: _kind(str(d[1])) for d in rows.description}
    ours = {f.name: _kind(f.dataType.simpleString()) for f in result.schema}
    if ours != theirs:
        return f"schema {ours} != {theirs}"
    names = sorted(ours)
    order = [d[0] for d in rows.description]
    expected = Counter(tuple(_cell(dict(zip(order, r))[n]) for n in names) for r in rows.fetchall())
    actual = Counter(tuple(_cell(r[n]) for n in names) for r in result.collect())
    if actual == expected:
        return None
    return f"{sum(actual.values())} rows != {sum(expected.values())}; only ours {list((actual - expected).items())[:3]}; only theirs {list((expected - actual).items())[:3]}"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from historymine.session import local_session

    sf_dir = f"{DATA}/{sys.argv[1]}"
    spark, con = local_session(8), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name, run in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            problem = difference(run(spark, sf_dir), con, oracle_sql()[name])
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print("failed:", failed)
