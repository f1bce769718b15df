"""Run registered queries next to their SQL statements: python tests/check_oracles.py [prefix ...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session():
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "10g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if not isinstance(x, float) else round(x, 4)) for x in r))


def close(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)) and not isinstance(b, bool):
        return a == b or abs(a - b) <= 2e-6 * max(1.0, abs(a))
    return a == b and (type(a) is type(b))


def compare(spark, con, name, fn, sql, folder):
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return ("rows", len(got), "")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return ("FAIL", len(got), f"columns {sorted(df.columns)} != {sorted(names)}")
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return ("FAIL", len(got), f"{len(a)} rows != {len(b)}; spark {a[:2]} sql {b[:2]}")
    inexact = 0
    for x, y in zip(a, b):
        if x != y:
            if not all(close(p, q) for p, q in zip(x, y)):
                return ("FAIL", len(got), f"{sorted(names)}\n   spark {x}\n   sql   {y}")
            inexact += 1
    return ("ok" if not inexact else "ok~", len(got), f"{inexact} rows differ in the last digit" if inexact else "")


def main(prefixes, folder="/root/testdata/sf0.01"):
    from __spark_entry__ import oracle_sql, queries

    spark, con = session(), duck(folder)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    slow = []
    for name, fn in qs.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            status, n, note = compare(spark, con, name, fn, sqls.get(name), folder)
        except Exception as e:  # report and go on with the next query
            status, n, note = "ERROR", -1, f"{type(e).__name__}: {str(e)[:700]}"
        dt = time.time() - t0
        slow.append((dt, name))
        bad += status in ("FAIL", "ERROR")
        if status != "ok" or n == 0 or prefixes:
            print(f"{status:6} {name:45} rows={n} {dt:.1f}s {note}", flush=True)
    print("bad:", bad, "of", len(slow), "slowest:", [(round(a, 1), b) for a, b in sorted(slow)[-8:]], "total", round(sum(a for a, _ in slow), 1))
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        folder, args = args[0], args[1:]
    sys.exit(1 if main(args, folder) else 0)
