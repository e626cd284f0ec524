"""Run registered queries beside their SQL and compare rows. ``python -m tests.oracle [names]``."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql):
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; e.g. {got[:1]} vs {want[:1]}"
    for g, w in zip(got, want):
        if g != w:
            return f"first difference\n   spark {g}\n   sql   {w}"
    return None


def main(names):
    from billspark.catalog import ORACLES, QUERIES
    from billspark.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    con = connect(folder)
    bad = 0
    picked = [n for n in QUERIES if not names or any(n == a or n.startswith(a.rstrip("*")) and a.endswith("*") for a in names)]
    for name in picked:
        t = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
                n = ""
            else:
                problem, n = None, f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", ""
        bad += problem is not None
        print(f"{'BAD' if problem else 'ok '} {name} {time.time() - t:.1f}s {n} {problem or ''}", flush=True)
    print(f"{len(picked)} run, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
