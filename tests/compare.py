"""Run registered queries beside their SQL and compare the values.

Usage: python tests/compare.py [sf] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

import duckdb
import pandas as pd

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: v if v is None or isinstance(v, (str, bool)) else str(v))
        elif str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns), ignore_index=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = _norm(got), _norm(want)
    for c in a.columns:
        if a[c].dtype.kind != b[c].dtype.kind:
            return f"{c}: type {a[c].dtype} != {b[c].dtype}"
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = same.idxmin()
            return f"{c}: {(~same).sum()} differ, e.g. {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from haulplan.session import local_session

    sf = f"{DATA}/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf), 0
    for name in names:
        start = time.time()
        try:
            got = entry.queries()[name](spark, sf).toPandas()
            took = time.time() - start
            sql = entry.oracle_sql().get(name)
            start = time.time()
            text = f"{len(got)} rows" if sql is None else difference(got, con.execute(sql).df()) or "same"
        except Exception as e:  # noqa: BLE001 - report and go on
            took, sql, text = time.time() - start, "", f"ERROR {str(e)[:600]}"
        wrong = sql is not None and text != "same"
        bad += wrong
        print(f"{'FAIL' if wrong else 'ok  '} {name:28s} {took:6.1f}s sql {time.time() - start:5.1f}s {text}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
