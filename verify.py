"""Run registered queries next to their oracle SQL and compare schema, rows and values.

    python verify.py [--sf DIR] [--only a,b,c] [--module name]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from importlib import import_module

import duckdb

from sigframe import catalog
from sigframe.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
KIND = {"bigint": "int64", "int": "int32", "double": "double", "string": "string", "boolean": "bool", "float": "float"}


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, d):
    t = time.time()
    df = catalog.QUERIES[name](spark, d)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - t
    sql = catalog.ORACLES.get(name)
    if sql is None:
        return ("ROWS" if got else "EMPTY"), spent, f"{len(got)} rows"
    t = time.time()
    tab = con.sql(sql).to_arrow_table()
    duck = time.time() - t
    want = list(zip(*[c.to_pylist() for c in tab.columns])) if tab.num_columns else []
    a, b = rows_of(df.columns, got), rows_of(tab.column_names, want)
    types = sorted((c, KIND.get(t, t)) for c, t in df.dtypes)
    wtypes = sorted((f.name, str(f.type)) for f in tab.schema)
    note = f"{len(got)} rows, oracle {duck:.2f}s"
    if types != wtypes:
        return "SCHEMA", spent, f"{note}: {[x for x in types if x not in wtypes]} vs {[x for x in wtypes if x not in types]}"
    if len(a) != len(b):
        return "COUNT", spent, f"{len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return "VALUES", spent, f"{len(bad)} of {len(a)} differ: {bad[0]}"
    return ("OK" if a else "OK-EMPTY"), spent, note


def main() -> int:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("--only")
    p.add_argument("--module")
    a = p.parse_args()
    if a.module:
        for m in a.module.split(","):
            import_module(f"sigframe.catalog.{m}")
    else:
        catalog.load()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{a.sf}/{t}.parquet'")
    names = a.only.split(",") if a.only else list(catalog.QUERIES)
    bad = 0
    for n in names:
        try:
            status, spent, note = compare(spark, con, n, a.sf)
        except Exception as e:  # report and go on
            status, spent, note = "ERROR", 0.0, str(e)[:1500]
        bad += status not in ("OK", "ROWS")
        print(f"{status:9s} {spent:6.2f}s {n}: {note}", flush=True)
    print(f"{len(names)} run, {bad} not ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
