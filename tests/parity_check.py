"""Compare every registered query with its SQL in DuckDB: python tests/parity_check.py [sf] [name ...]"""
from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_module  # noqa: E402
from dossier.session import local_session  # noqa: E402
from dossier.sources.tables import TABLES  # noqa: E402


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False, name=None):
        cells = []
        for v in row:
            if v is None or pd.isna(v):
                cells.append("~")
            elif isinstance(v, bool) or type(v).__name__ == "bool_":
                cells.append(str(bool(v)))
            elif isinstance(v, float) or type(v).__name__.startswith("float"):
                cells.append(f"{float(v):.6f}")
            elif type(v).__name__.startswith("int"):
                cells.append(f"{int(v)}")
            else:
                cells.append(str(v))
        out.append("|".join(cells))
    return sorted(out)


def duck(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder, name):
    query, sql = entry_module.queries()[name], entry_module.oracle_sql().get(name)
    start = time.time()
    left = query(spark, folder)
    types = dict(left.dtypes)
    left = left.toPandas()
    left = left.astype({c: "Int64" for c, t in types.items() if t in ("bigint", "int") and left[c].dtype.kind == "f"})
    seconds = time.time() - start
    if sql is None:
        return "rows only", len(left), seconds, ""
    start = time.time()
    result = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in result.description}
    right = result.df()
    note = f"duck {time.time() - start:.1f}s"
    if sorted(left.columns) != sorted(right.columns):
        return "COLUMNS", len(left), seconds, f"{sorted(left.columns)} vs {sorted(right.columns)}"
    a, b = rows_of(left), rows_of(right)
    if len(a) != len(b):
        return "COUNT", len(a), seconds, f"{len(a)} vs {len(b)}"
    if a != b:
        wrong = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return "VALUES", len(a), seconds, "\n   ".join(f"{x}\n   {y}" for x, y in wrong)
    odd = [f"{c}:{types[c]}/{kinds[c]}" for c in types
           if {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
               "boolean": "BOOLEAN"}.get(types[c], "?") != kinds[c]]
    return "ok", len(a), seconds, note + (" types " + ",".join(odd) if odd else "")


def main():
    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:] or list(entry_module.queries())
    spark = local_session("8", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name in names:
        try:
            state, rows, seconds, note = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            state, rows, seconds, note = "ERROR", 0, 0.0, str(error)[:1500]
        bad += state not in ("ok", "rows only")
        print(f"{state:10} {name:28} {rows:8} rows {seconds:6.1f}s {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
