"""Run a catalog query on Spark and its SQL twin on DuckDB and compare the two results."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.9g}" if v != 0 else "0"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(cell(x)) for x in v) + "]"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(cell(r[i])) for i in order) for r in rows)


def compare(q, spark, con, sf_dir):
    """(ok, message) for one catalog query."""
    df = q.run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    sql = q.oracle()
    if sql is None:
        return True, f"rows only: {len(got)}"
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    odd = [(c[0], str(c[1])) for c in res.description if "HUGEINT" in str(c[1]) or "DECIMAL" in str(c[1])]
    want = res.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if len(a) != len(b):
        return False, f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if bad:
        return False, f"{len(bad)}/{len(a)} rows differ, e.g. {sorted(cols)} spark {bad[0][0]} oracle {bad[0][1]}"[:900]
    if odd:
        return False, f"wide types in the oracle: {odd}"
    return True, f"ok {len(a)}"


if __name__ == "__main__":
    import importlib
    import sys
    import time
    import traceback

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from comarca.session import local_session

    sf = f"/root/testdata/{sys.argv[1]}"
    module = sys.argv[2]
    from comarca.plans import catalog

    if module == "all":
        importlib.import_module("comarca.plans")
    else:
        # import the one module without the package's full registration
        for m in module.split(","):
            importlib.import_module(f"comarca.plans.{m}")
    only = set(sys.argv[3].split(",")) if len(sys.argv) > 3 else None
    spark = local_session(8)
    con = oracle(sf)
    fails = 0
    for name, q in catalog.CATALOG.items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            ok, msg = compare(q, spark, con, sf)
        except Exception as e:
            ok, msg = False, "".join(traceback.format_exception_only(e))[:1500]
        fails += not ok
        print(f"{'PASS' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {msg}", flush=True)
    print("failures", fails, "of", len(catalog.CATALOG))
