"""Run every registered query against its SQL in DuckDB and compare values.

    python tools/check_queries.py [folder] [name-part ...]
"""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from demandpanel.catalog import ORACLES, QUERIES
from demandpanel.session import local_session


def connect(folder: str):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))


def compare(spark, con, name: str, folder: str) -> tuple[str, int, float]:
    start = time.time()
    df = QUERIES[name](spark, folder)
    rows = df.collect()
    took = time.time() - start
    if name not in ORACLES:
        return "rows-only", len(rows), took
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    expected = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(names)}", len(rows), took
    kinds = {d[0]: str(d[1]).upper() for d in cur.description}
    same = {"bigint": "BIGINT", "double": "DOUBLE", "date": "DATE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER",
            "timestamp_ntz": "TIMESTAMP"}
    odd = [f"{c}:{t}/{kinds[c]}" for c, t in df.dtypes if same.get(t, "?") not in kinds[c] and not t.startswith("array")
           and not ({t, kinds[c]} & {"string"} and "STRING" in kinds[c]) and not (t == "bigint" and "NUMBER" in kinds[c])]
    a, b = canonical([tuple(r) for r in rows], df.columns), canonical(expected, names)
    if len(a) != len(b):
        return f"ROWS {len(a)} vs {len(b)}", len(rows), took
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if bad:
        return f"VALUES {len(bad)}/{len(a)} {sorted(names)} first: {bad[0][0]} vs {bad[0][1]}"[:900], len(rows), took
    return ("ok" if not odd else f"ok (types {odd})"), len(rows), took


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark, con, failed = local_session(8), connect(folder), 0
    for name in QUERIES:
        if parts and not any(p in name for p in parts):
            continue
        try:
            verdict, n, took = compare(spark, con, name, folder)
        except Exception as error:  # keep going, report all
            verdict, n, took = "ERROR " + str(error).split("JVM stacktrace")[0][:600], -1, 0.0
        if not verdict.startswith(("ok", "rows-only")):
            failed += 1
        print(f"{name:40s} {n:7d} {took:6.2f}s {verdict}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
