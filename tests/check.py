"""Compare registered queries with their oracle text on DuckDB.

usage: python tests/check.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd


def oracle(con, sql: str) -> pd.DataFrame:
    return con.sql(sql).df()


def connect(path: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(glob.glob(f"{path}/*.parquet")):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        out = []
        for v in row:
            if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
                out.append("~")
            elif isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
                out.append(str(bool(v)))
            elif hasattr(v, "dtype") and v.dtype.kind in "iu" or isinstance(v, int):
                out.append(repr(float(v)))
            elif isinstance(v, float) or hasattr(v, "dtype") and getattr(v, "dtype").kind == "f":
                out.append(repr(float(v)))
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return sorted(rows)


def diff(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    for c in got.columns:
        a, b = got[c].dtype, want[c].dtype
        if a.kind != b.kind and len(got) and not (got[c].isna().any() or want[c].isna().any()):
            return f"dtype of {c}: {a} vs {b}"
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {sorted(got.columns)}\n   got  {bad[0][0]}\n   want {bad[0][1]}"
    return None


def main() -> None:
    from tidegauge.catalog import load
    from tidegauge.session import builder

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    path = f"/root/testdata/sf{sf}"
    spark = builder("check").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(path)
    bad = 0
    for name, q in load().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            t = time.time()
            got = q.run(spark, path).toPandas()
            took = time.time() - t
            if q.sql is None:
                print(f"rows {name:34s} {len(got):7d} rows {took:6.2f}s", flush=True)
                continue
            problem = diff(got, oracle(con, q.sql))
        except Exception as e:  # report and go on
            problem, took, got = f"{type(e).__name__}: {str(e)[:900]}", 0.0, []
        bad += problem is not None
        print(f"{'ok  ' if not problem else 'FAIL'} {name:34s} {len(got):7d} rows {took:6.2f}s {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
