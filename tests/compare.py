"""Run registered queries next to their SQL in DuckDB and compare schema, row count and values."""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from weirworks.plans.load import REGISTRY  # noqa: E402
from weirworks.plans.registry import TABLES  # noqa: E402
from weirworks.session import local_session  # noqa: E402


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "asDict"):
        return tuple((k, plain(v)) for k, v in sorted(value.asDict().items()))
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "tzinfo") and getattr(value, "tzinfo", None) is not None:
        return value.replace(tzinfo=None)
    return value


def compare(spark, con, folder: str, name: str) -> tuple[str, float, int]:
    q = REGISTRY[name]
    start = time.time()
    df = q.run(spark, folder)
    got = df.collect()
    took = time.time() - start
    if q.oracle is None:
        return "rows only", took, len(got)
    rel = con.execute(q.oracle)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}", took, len(got)
    cols = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got), key=repr)
    at = [names.index(c) for c in cols]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want), key=repr)
    if len(a) != len(b):
        return f"ROWS {len(a)} != {len(b)}", took, len(got)
    for x, y in zip(a, b, strict=True):
        if x != y or [type(v) for v in x] != [type(v) for v in y]:
            return f"VALUES {cols} {x} != {y}", took, len(got)
    return "ok", took, len(got)


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--dir", default="/root/testdata/sf0.001")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(opts.dir)
    bad = 0
    for name in REGISTRY:
        if opts.names and not any(n in name for n in opts.names):
            continue
        try:
            verdict, took, rows = compare(spark, con, opts.dir, name)
        except Exception as e:  # report and go on with the next query
            verdict, took, rows = f"ERROR {type(e).__name__}: {str(e)[:900]}", 0.0, -1
        bad += verdict not in ("ok", "rows only")
        print(f"{name:36s} {took:6.2f}s {rows:8d}  {verdict}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
