"""Run registered queries next to their SQL checks and compare all rows.

    python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TIMES: dict[str, float] = {}  # Spark seconds per query
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "~null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


def family(t: str) -> str:
    t = t.lower()
    if t.startswith(("bigint", "long", "int", "integer", "hugeint", "smallint", "number")):
        return "int"
    if t.startswith(("double", "float", "decimal", "real")):
        return "float"
    return {"varchar": "string", "bool": "boolean"}.get(t, t.split("(")[0])


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, else a text telling the difference."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    TIMES[name] = time.time() - t0
    if sql is None:
        return None, len(got)
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want_types = {c[0]: family(str(c[1])) for c in cur.description}
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}", len(got)
    got_types = {f.name: family(f.dataType.simpleString()) for f in df.schema}
    if got_types != want_types:
        return f"types {[(k, v, want_types[k]) for k, v in got_types.items() if v != want_types[k]]}", len(got)
    a, b = rows(df.columns, got), rows(want_cols, want)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return f"rows {len(a)} vs {len(b)}; only spark {str(only_a)[:1500]}; only sql {str(only_b)[:1500]}", len(got)
    return None, len(got)


def main(argv):
    from corpusloom.plans import registry
    from corpusloom.session import build_session

    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2 :]
    registry.load()
    spark = build_session(master="local[8]")
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    bad = 0
    for name in argv or registry.QUERIES:
        t0 = time.time()
        try:
            err, n = compare(spark, con, name, registry.QUERIES[name], registry.ORACLE.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            err, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        bad += err is not None
        mark = "FAIL" if err else ("ok" if name in registry.ORACLE else "rows")
        print(f"{mark:5} {name:28} {n:8} rows spark {TIMES.get(name, -1):6.2f}s all {time.time() - t0:6.2f}s {err or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
