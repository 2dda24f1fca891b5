"""Run a registered query in Spark and its SQL in DuckDB and compare the results value by value."""

from __future__ import annotations

import datetime
import decimal
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, decimal.Decimal):
        return repr(int(value)) if value == value.to_integral_value() else repr(float(value))
    if isinstance(value, float):
        return "%.9g" % value if value != int(value) else repr(float(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, function, sql):
    """Problems found, or an empty list."""
    frame = function(spark, folder)
    got_cols, got = rows_of(frame.columns, frame.collect())
    result = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    if len(set(got_cols)) != len(got_cols):
        return ["repeated column names"]
    problems = []
    if not want:
        problems.append("check is empty")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        a, b = set(got), set(want)
        problems += [f"only spark: {r}" for r in sorted(a - b)[:3]] + [f"only check: {r}" for r in sorted(b - a)[:3]]
        problems.append(f"columns: {got_cols}")
    return problems


def main(names):
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from weblode.plans import registry
    from weblode.session import build_session

    registry.load()
    folder = "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name in names or registry.QUERIES:
        begin = time.time()
        sql = registry.CHECKS.get(name)
        try:
            if sql is None:
                found = [f"no check, rows {registry.QUERIES[name](spark, folder).count()}"]
            else:
                found = compare(spark, con, folder, name, registry.QUERIES[name], sql)
        except Exception as error:
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        print(f"@@ {'ok ' if not found else 'BAD'} {name} {time.time() - begin:.1f}s", *found, sep="\n@@    " if found else "", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
