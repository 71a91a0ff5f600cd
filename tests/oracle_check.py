"""Run registered queries next to their SQL in DuckDB and compare the rows.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def norm(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        f = float(value)
        return "nan" if math.isnan(f) else f"{f:.6g}" if f else "0"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(norm(v) for v in value) + "]"
    return str(value)


def oracle_rows(sf_dir, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def compare(spark, sf_dir, name, fn, sql):
    start = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return False, f"{len(rows)} rows, no SQL to compare with", took
    start = time.time()
    cols, want = oracle_rows(sf_dir, sql)
    sql_took = time.time() - start
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}", took
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    mine = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    a = sorted(tuple(norm(r[i]) for i in mine) for r in rows)
    b = sorted(tuple(norm(r[i]) for i in order) for r in want)
    if a != b:
        extra = [x for x in a if x not in set(b)][:3]
        miss = [x for x in b if x not in set(a)][:3]
        return False, f"{len(a)} vs {len(b)} rows; only spark {str(extra)[:700]}; only sql {str(miss)[:700]}", took
    return True, f"{len(a)} rows, sql {sql_took:.1f}s", took


def main():
    import __spark_entry__ as entry
    from quire.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = local_session("oracle-check", cores="8", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if only and name not in only:
            continue
        try:
            ok, note, took = compare(spark, sf_dir, name, fn, oracles.get(name))
        except Exception as exc:  # report every query
            ok, note, took = False, f"{type(exc).__name__}: {str(exc)[:900]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {took:6.1f}s  {note}", flush=True)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
