"""Compare queries with their SQL on one scale: python check.py [--sf DIR] [pattern ...]"""

from __future__ import annotations

import argparse
import fnmatch
import importlib
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: "NULL" if v is None or v is pd.NaT or v != v else str(v))
        else:
            df[c] = df[c].map(lambda v: "NULL" if pd.isna(v) else repr(float(v)) if not isinstance(v, (bool,)) else str(v))
    df = df.replace({"NaT": "NULL", "nan": "NULL", "None": "NULL"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--module", default="__spark_entry__")
    ap.add_argument("--plain", action="store_true", help="a session with Spark's own defaults")
    ap.add_argument("patterns", nargs="*", default=["*"])
    a = ap.parse_args()
    if a.plain:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    else:
        from skycast.session import local_session

        spark = local_session()
    mod = importlib.import_module(a.module)
    qs, sql = (mod.queries(), mod.oracle_sql()) if hasattr(mod, "queries") else _registry()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{a.sf}/{t}.parquet'")
    bad = 0
    for name, fn in qs.items():
        if not any(fnmatch.fnmatch(name, p) for p in a.patterns):
            continue
        t0 = time.time()
        try:
            got = fn(spark, a.sf).toPandas()
            took = time.time() - t0
            if name not in sql:
                print(f"ROWS  {name:42s} {len(got):8d} rows {took:6.1f}s", flush=True)
                continue
            want = con.execute(sql[name]).df()
            g, w = normal(got), normal(want)
            if list(g.columns) != list(w.columns):
                raise AssertionError(f"columns {list(g.columns)} vs {list(w.columns)}")
            if len(g) != len(w):
                raise AssertionError(f"{len(g)} rows vs {len(w)}")
            diff = [c for c in g.columns if not (g[c] == w[c]).all()]
            if diff:
                c = diff[0]
                i = (g[c] != w[c]).idxmax()
                raise AssertionError(f"{diff}: {int((g[c] != w[c]).sum())} rows, e.g.\n   {g.loc[i].to_dict()}\n   {w.loc[i].to_dict()}")
            print(f"OK    {name:42s} {len(got):8d} rows {took:6.1f}s" + ("  (empty)" if not len(got) else ""), flush=True)
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name:42s} {time.time() - t0:6.1f}s {type(exc).__name__}: {str(exc)[:1500]}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


def _registry():
    from catalog import registry

    return registry.QUERIES, registry.SQL


if __name__ == "__main__":
    raise SystemExit(main())
