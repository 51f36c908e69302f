"""Compares queries with their SQL as run by DuckDB: python tests/oracle.py [FOLDER] [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

FOLDER = "/root/testdata/sf0.01"


def connect(folder: str = FOLDER) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(_cell(v) for v in x)
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, query, sql: str, folder: str = FOLDER) -> str:
    """'same' with the number of rows if both sides agree, else what differs."""
    df = query(spark, folder)
    ours = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    theirs = rows_of(columns, rel.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if ours == theirs:
        return f"same, {len(ours)} rows"
    a, b = set(ours), set(theirs)
    return f"{len(ours)} and {len(theirs)} rows; only ours {sorted(a - b, key=repr)[:3]}; only SQL {sorted(b - a, key=repr)[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tidewire.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else FOLDER
    spark, con, sql = local_session(), connect(folder), entry.oracle_sql()
    for name, query in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        began = time.time()
        try:
            said = compare(spark, con, name, query, sql[name], folder) if name in sql else f"(no SQL) {query(spark, folder).count()} rows"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
