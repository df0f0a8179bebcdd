"""Runs queries beside their SQL and compares rows; used by tests and from the command line."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd


def connect(folder: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple("\0" if pd.isna(v) else repr(v.item()) if hasattr(v, "item") else repr(v) for v in r) for r in pdf.astype(object).itertuples(index=False, name=None))


def differences(spark, con, query, sql: str, folder: str) -> str:
    """Empty if the rows are equal."""
    ours, theirs = query(spark, folder).toPandas(), con.sql(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    for c in ours.columns:  # whole numbers that became floats through NULLs
        if ours[c].dtype.kind == "f" or theirs[c].dtype.kind == "f":
            ours[c], theirs[c] = ours[c].astype(float), theirs[c].astype(float)
    a, b = rows(ours), rows(theirs)
    if a != b:
        sa, sb = set(a), set(b)
        return f"{len(a)} and {len(b)} rows; only here {sorted(sa - sb)[:2]}; only there {sorted(sb - sa)[:2]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from conftest import session

    spark, folder = session(), sys.argv[1]
    con = connect(folder)
    names, sql = sys.argv[2:] or list(entry.queries()), entry.oracle_sql()
    for name in names:
        began = time.time()
        try:
            said = differences(spark, con, entry.queries()[name], sql[name], folder) if name in sql else f"no SQL; {entry.queries()[name](spark, folder).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:400]}"
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
