"""Compare queries with their SQL twins: python tests/oracle_check.py [sf dir] [query …]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages benchmark
labels conversations""".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for column in frame.columns:
        values = frame[column]
        if pd.api.types.is_bool_dtype(values):
            frame[column] = values.map(str)
        elif pd.api.types.is_numeric_dtype(values):
            frame[column] = values.astype(float).map(lambda v: "null" if pd.isna(v) else repr(v + 0.0))
        else:
            frame[column] = values.map(lambda v: "null" if v is None or v is pd.NaT else str(pd.Timestamp(v)) if hasattr(v, "year") else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    a, b = canonical(got), canonical(want)
    differ = (a != b).any(axis=1)
    if not differ.any():
        return None
    at = differ.idxmax()
    return f"{int(differ.sum())} rows differ, first:\n  {a.loc[at].to_dict()}\n  {b.loc[at].to_dict()}"


def check(spark, con, name: str, run, sql: str | None, sf_dir: str) -> tuple[str | None, float, int]:
    start = time.time()
    got = run(spark, sf_dir).toPandas()
    took = time.time() - start
    if sql is None:
        return (None if len(got) else "no rows"), took, len(got)
    return compare(got, con.execute(sql).fetchdf()), took, len(got)


if __name__ == "__main__":
    import __spark_entry__ as entry
    from seriesloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(8), connect(sf)
    spark.sparkContext.setLogLevel("OFF")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    queries, oracles = entry.queries(), entry.oracle_sql()
    print("oracles without a query:", sorted(set(oracles) - set(queries)))
    bad = 0
    for name in sys.argv[2:] or queries:
        try:
            problem, took, rows = check(spark, con, name, queries[name], oracles.get(name), sf)
        except Exception as failure:
            problem, took, rows = f"{type(failure).__name__}: {str(failure)[:900]}", 0.0, 0
        bad += problem is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {name:32s} {rows:7d} rows {took:6.2f}s {problem or ''}", flush=True)
    print("failures:", bad)
