"""Run registered queries beside their SQL and report differences.

    python tests/oracle.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, decimal.Decimal):
        return ("n", float(v)) if v != int(v) else ("n", float(int(v)))
    if isinstance(v, int):
        return ("n", float(v))
    if isinstance(v, float):
        if math.isnan(v):
            return ("n", "nan")
        return ("n", float(f"{v:.12g}"))
    if isinstance(v, (dt.datetime, dt.date)):
        return ("d", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("l", tuple(plain(x) for x in v))
    return ("s", str(v))


def kind(type_name: str) -> str:
    t = str(type_name).lower()
    if any(k in t for k in ("struct", "map", "[]", "array", "list")):
        return "nested"
    if any(k in t for k in ("int", "long", "short")):
        return "int"
    if any(k in t for k in ("double", "float", "real")):
        return "float"
    if "decimal" in t:
        return "decimal"
    if "bool" in t:
        return "bool"
    if "timestamp_ntz" in t or t == "timestamp":
        return "timestamp"
    if "timestamp" in t:
        return "timestamptz"
    if "date" in t:
        return "date"
    return "string"


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in data), order


def compare(spark, con, name, fn, sql, folder):
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    gc, gr, go = rows_of(df.columns, got)
    gk = [kind(df.schema.fields[i].dataType.simpleString()) for i in go]
    if sql is None:
        return f"rows only ({len(got)})", True
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = [kind(d[1]) for d in cur.description]
    want = cur.fetchall()
    wc, wr, wo = rows_of(names, want)
    wk = [types[i] for i in wo]
    if gc != wc:
        return f"COLUMNS {gc} != {wc}", False
    if gk != wk:
        return "TYPES " + ", ".join(f"{c}: {a}/{b}" for c, a, b in zip(gc, gk, wk) if a != b), False
    if gr != wr:
        a, b = list((gr - wr).items())[:3], list((wr - gr).items())[:3]
        return f"VALUES spark {len(got)} rows, sql {len(want)}; columns {gc}\n  spark only {a}\n  sql only   {b}", False
    return f"ok ({len(got)})", len(got) > 0


def main():
    from veriscope.session import build_session
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i : i + 2]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g", "spark.log.level": "ERROR"})
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            message, ok = compare(spark, con, name, fn, oracles.get(name), folder)
        except Exception as e:  # report and go on
            message, ok = f"{type(e).__name__}: {str(e)[:700]}", False
        print(f"{'  ' if ok else '!!'} {name} {time.time() - start:.1f}s {message}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
