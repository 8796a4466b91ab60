"""Run registered queries beside their SQL and compare: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _sortable(row):
    return tuple((value is not None, str(type(value)), value) for value in row)


def _clean(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


# Types of the two engines that hold the same values.
SAME_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> tuple[str, int]:
    frame = query(spark, sf_dir)
    columns = sorted(frame.columns)
    mine = sorted((tuple(_clean(v) for v in row) for row in frame.select(*columns).collect()), key=_sortable)
    relation = con.sql(sql)
    if sorted(relation.columns) != columns:
        return f"columns {columns} != {sorted(relation.columns)}", len(mine)
    types = dict(zip(relation.columns, map(str, relation.types)))
    for field in frame.schema.fields:
        if SAME_TYPES.get(field.dataType.simpleString()) != types[field.name]:
            return f"type of {field.name}: {field.dataType.simpleString()} != {types[field.name]}", len(mine)
    picked = ", ".join(f'"{c}"' for c in columns)
    other = sorted((tuple(_clean(v) for v in row) for row in relation.project(picked).fetchall()), key=_sortable)
    if len(mine) != len(other):
        return f"{len(mine)} rows != {len(other)}", len(mine)
    for a, b in zip(mine, other):
        if a != b:
            return f"{a} != {b}", len(mine)
    return "", len(mine)


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    con = connect(sf_dir)
    bad = []
    for name in argv[1:] or queries:
        started = time.time()
        try:
            if name in oracle:
                problem, rows = compare(spark, con, name, queries[name], oracle[name], sf_dir)
            else:
                problem, rows = "", queries[name](spark, sf_dir).count()
        except Exception as error:  # the report goes on with the next query
            problem, rows = f"{type(error).__name__}: {str(error)[:400]}", -1
        kind = "sql " if name in oracle else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:28s} {rows:8d} rows {time.time() - started:6.1f}s {problem}", flush=True)
        if problem:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
