"""Run catalogued queries on Spark and their check SQL, and compare rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


SAME = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return repr(float(value))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, name, fn, sql):
    start = time.time()
    df = fn(spark, folder)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return "rows-only", len(got), took, ""
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return "COLUMNS", len(got), took, f"{sorted(df.columns)} / {sorted(cols)}"
    if got == want:
        mine = {f.name: SAME.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
        odd = {d[0]: f"{mine[d[0]]}/{d[1]}" for d in cur.description if mine[d[0]] != str(d[1])}
        return ("types" if odd else "ok"), len(got), took, odd or ""
    only_a = [r for r in got if r not in set(want)][:3]
    only_b = [r for r in want if r not in set(got)][:3]
    return "DIFF", len(got), took, f"{sorted(cols)}\n   rows {len(got)}/{len(want)}\n   spark {only_a}\n   check {only_b}"


def main(folder: str, names: list[str]) -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from docsentry import session

    spark = session.build(master="local[8]", **{"spark__sql__shuffle__partitions": "8", "spark__ui__enabled": "false", "spark__driver__memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and name not in names:
            continue
        try:
            status, n, took, note = compare(spark, con, folder, name, fn, checks.get(name))
        except Exception as e:  # report and go on to the next query
            status, n, took, note = "ERROR", 0, 0.0, str(e)[:700]
        bad += status not in ("ok", "rows-only")
        print(f"{status:10s} {name:38s} {n:8d} {took:6.1f}s {note}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
