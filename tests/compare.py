"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(root):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v) if v != int(v) or abs(v) > 1e15 else repr(int(v))
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, root, name, fn, sql, show=3):
    t = time.time()
    df = fn(spark, root)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return f"rows-only {len(rows)}", took
    t = time.time()
    cur = con.execute(sql)
    theirs = cur.fetchall()
    duck = time.time() - t
    names, mine = table(df.columns, rows)
    other_names, other = table([d[0] for d in cur.description], theirs)
    if names != other_names:
        return f"DIFF columns {names} vs {other_names}", took
    if mine != other:
        a, b = set(mine), set(other)
        lines = [f"DIFF rows {len(mine)} vs {len(other)}; only spark {len(a - b)}, only sql {len(b - a)}", str(names)]
        lines += [f"  spark {r}" for r in sorted(a - b)[:show]] + [f"  sql   {r}" for r in sorted(b - a)[:show]]
        return "\n".join(lines), took
    return f"ok {len(mine)} (duck {duck:.1f}s)", took


def main():
    import traceback

    import __spark_entry__ as entry
    from lakewarden.session import build_session

    root = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            out, took = compare(spark, con, root, name, fn, sqls.get(name))
        except Exception as exc:
            out, took = "ERROR " + str(exc).strip()[:900], 0
            if len(wanted) == 1:
                traceback.print_exc()
        bad += out.startswith(("DIFF", "ERROR"))
        print(f"{name:34s} {took:6.1f}s  {out}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
