"""Compare registered queries with their SQL at one scale: ``python tests/check_queries.py [sf] [name ...]``."""

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from terrascreen.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        if value == int(value) and abs(value) < 1e15:
            return f"{int(value)}"
        return f"{value:.9g}"
    if value is None:
        return ""
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def main():
    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    wanted = sys.argv[2:]
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    spark = local_session()
    checks = entry.oracle_sql()
    bad = []
    for name, run in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - start
            if name not in checks:
                print(f"rows {name} {len(got)} {took:.2f}s {got[:2]}")
                continue
            cur = con.execute(checks[name])
            ocols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
            types = dict(df.dtypes)
            otypes = {d[0]: str(d[1]) for d in cur.description}
            if cols != ocols:
                bad.append(name)
                print(f"COLS {name} {cols} {ocols}")
            elif got != want:
                bad.append(name)
                diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
                print(f"DIFF {name} {len(got)} vs {len(want)} {took:.2f}s cols={cols}\n   only spark {sorted(set(got) - set(want))[:3]}\n   only sql {sorted(set(want) - set(got))[:3]}")
            else:
                odd = {c: (types[c], otypes[c]) for c in cols if compatible(types[c], otypes[c]) is False}
                print(f"ok   {name} {len(got)} {took:.2f}s {odd or ''}" + ("  EMPTY" if not got else ""))
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            text = str(error).split("JVM stacktrace")[0]
            print(f"FAIL {name} {type(error).__name__} {text[:900]}")
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad:", bad)


def compatible(spark_type, duck_type):
    table = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    return table.get(spark_type) == duck_type


if __name__ == "__main__":
    main()
