"""Compare registered Spark queries with their DuckDB oracles."""

from __future__ import annotations

import math
import sys

import duckdb
import pandas as pd

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm_val(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return repr(round(v, 9))
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm_val(x) for x in v) + "]"
    try:
        import numpy as np
        if isinstance(v, np.ndarray):
            return "[" + ",".join(_norm_val(x) for x in v.tolist()) + "]"
        if isinstance(v, np.generic):
            return _norm_val(v.item())
    except ImportError:
        pass
    if isinstance(v, bool):
        return str(v)
    return str(v)


def canon(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm_val(r[c]) for c in cols) for r in df.to_dict("records")]
    return sorted(rows)


def compare(spark, con, name, fn, sql, sf_dir) -> tuple[bool, str]:
    sp = fn(spark, sf_dir).toPandas()
    if sql is None:
        return True, f"{name}: rows={len(sp)} (no oracle)"
    dd = con.execute(sql).df()
    if sorted(sp.columns) != sorted(dd.columns):
        return False, f"{name}: columns differ spark={sorted(sp.columns)} duck={sorted(dd.columns)}"
    if len(sp) != len(dd):
        return False, f"{name}: rows spark={len(sp)} duck={len(dd)}"
    for c in sp.columns:
        if str(dd[c].dtype) == "Int64" and str(sp[c].dtype) == "float64":
            sp[c] = sp[c].astype("Int64")
    a, b = canon(sp), canon(dd)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"{name}: values differ, first: {diff}"
    dt = {c: (str(sp[c].dtype), str(dd[c].dtype)) for c in sp.columns if str(sp[c].dtype) != str(dd[c].dtype)}
    return True, f"{name}: OK rows={len(sp)}" + (f" dtype-note={dt}" if dt else "")


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from lineaweave.session import build_session
    import __spark_entry__ as E
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = build_session()
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = ran = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            ok, msg = compare(spark, con, name, fn, os_.get(name), sf_dir)
        except Exception as e:  # report and continue
            ok, msg = False, f"{name}: ERROR {type(e).__name__}: {str(e)[:600]}"
        ran += 1
        bad += not ok
        print(("PASS " if ok else "FAIL ") + msg, flush=True)
    print(f"{ran - bad}/{ran} passed")
