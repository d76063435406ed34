"""Spark-vs-DuckDB comparison in the spirit of the driver's correctness gate:
row count, column names and an order-insensitive multiset of values.

Usable as a script: ``python tests/oracle_compare.py sf0.01 [name ...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

RAW_VIEWS = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck_connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in RAW_VIEWS:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_cols = list(sdf.columns)
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    t2 = time.time()
    out = {"name": name, "rows": len(s_rows), "oracle_rows": len(d_rows), "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2)}
    out["columns_match"] = sorted(s_cols) == sorted(d_cols)
    if out["columns_match"]:
        order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        d_index = {c: i for i, c in enumerate(d_cols)}
        s_vals = sorted((tuple(_norm(r[i]) for i in order) for r in s_rows), key=_key)
        d_vals = sorted((tuple(_norm(r[d_index[s_cols[i]]]) for i in order) for r in d_rows), key=_key)
        out["values_match"] = s_vals == d_vals
        if not out["values_match"]:
            diff_s = [v for v in s_vals if v not in d_vals][:3]
            diff_d = [v for v in d_vals if v not in s_vals][:3]
            out["example"] = {"columns": [s_cols[i] for i in order], "spark_only": diff_s, "oracle_only": diff_d}
    else:
        out["values_match"] = False
        out["example"] = {"spark_cols": s_cols, "oracle_cols": d_cols}
    out["ok"] = out["columns_match"] and out["values_match"] and len(s_rows) == len(d_rows)
    return out


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from marketlens.plans.registry import ORACLE_SQL, QUERIES
    from marketlens.session import build_session

    sf = argv[1] if len(argv) > 1 else "sf0.01"
    sf_dir = sf if sf.startswith("/") else f"/root/testdata/{sf}"
    names = argv[2:] or [n for n in QUERIES if n in ORACLE_SQL]
    spark = build_session()
    con = duck_connect(sf_dir)
    bad = 0
    for name in names:
        try:
            res = compare(spark, con, name, QUERIES[name], ORACLE_SQL[name], sf_dir)
        except Exception as exc:  # report and continue
            res = {"name": name, "ok": False, "error": repr(exc)[:800]}
        bad += not res["ok"]
        print(res, flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
