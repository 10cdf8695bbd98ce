"""Runs registered queries against their DuckDB equivalents.

Usage: python tests/oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def normal(frame: pd.DataFrame) -> list[tuple]:
    def cell(value):
        if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and np.isnan(value)):
            return None
        if isinstance(value, np.generic):
            value = value.item()
        if isinstance(value, float) and value.is_integer():
            return repr(int(value))
        return repr(value) if not isinstance(value, str) else value

    columns = sorted(frame.columns)
    rows = [tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, db, query, sql: str, sf_dir: str) -> str | None:
    """None when both sides agree, else what differs."""
    got, want = query(spark, sf_dir).toPandas(), db.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    left, right = normal(got), normal(want)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}: {[x for x in left if x not in right][:2]} / {[x for x in right if x not in left][:2]}"
    for a, b in zip(left, right):
        if a != b:
            return f"first difference {a} != {b}"
    return None


def main() -> None:
    from spanloom.session import local_session
    from spanloom.workloads import all_workloads

    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf_dir, args = args[1], args[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    for name, (query, sql) in all_workloads().items():
        if args and not any(name == a or name.startswith(a + "*") for a in args):
            continue
        began = time.time()
        try:
            if sql is None:
                problem = f"rows only: {query(spark, sf_dir).count()}"
            else:
                problem = compare(spark, db, query, sql, sf_dir) or "ok"
        except Exception as error:  # report every query
            problem = f"FAILED {type(error).__name__}: {str(error)[:700]}"
        print(f"@@ {name}: {problem[:1200]} ({time.time() - began:.1f}s)", flush=True)


if __name__ == "__main__":
    main()
