"""Run registered queries against their DuckDB oracles (a local stand-in for
the driver's check): row count, column names, order-insensitive values.

    python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


SPARK_TO_DUCK = {"boolean": "BOOLEAN", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if v is None:
        return "null"
    return str(v)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    t0 = time.time()
    df = query(spark, sf_dir)
    s_rows = [tuple(r) for r in df.collect()]
    s_cols = df.columns
    t1 = time.time()
    if sql is None:
        return {"name": name, "ok": None, "rows": len(s_rows), "spark_s": round(t1 - t0, 2)}
    rel = con.sql(sql)
    d_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = [tuple(r) for r in res.fetchall()]
    ok_cols = sorted(s_cols) == sorted(d_cols)
    s_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in df.schema.fields}
    ok_types = all(s_types[c] == d_types.get(c) for c in s_cols)
    ok_rows = len(s_rows) == len(d_rows)
    ok_vals = ok_cols and ok_rows and canon(s_cols, s_rows) == canon(d_cols, d_rows)
    out = {"name": name, "ok": bool(ok_vals), "rows": len(s_rows), "oracle_rows": len(d_rows),
           "cols": ok_cols, "types": ok_types, "spark_s": round(t1 - t0, 2)}
    if not ok_types:
        out["type_diff"] = {c: (s_types[c], d_types.get(c)) for c in s_cols if s_types[c] != d_types.get(c)}
    if not ok_vals and ok_cols and ok_rows:
        a, b = canon(s_cols, s_rows), canon(d_cols, d_rows)
        diffs = [(x, y) for x, y in zip(a, b) if x != y]
        out["n_diff"] = len(diffs)
        out["first_diff"] = diffs[:2]
    if not ok_cols:
        out["spark_cols"], out["oracle_cols"] = s_cols, d_cols
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from __spark_entry__ import oracle_sql, queries
    from parallax.session import local_session

    spark = local_session(8)
    con = duck(sf_dir)
    qs, oracles = queries(), oracle_sql()
    bad = 0
    for name, q in qs.items():
        if names and name not in names:
            continue
        r = compare(spark, con, name, q, oracles.get(name), sf_dir)
        bad += r["ok"] is False
        print(r, flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
