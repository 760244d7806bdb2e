"""Compares catalogue queries with their SQL: columns, row count, values, per query."""

from __future__ import annotations

import math
import os
import time

import duckdb

TABLES = ["region", "nation", "customer", "orders", "documents", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    db = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{files}'")
    return db


def _normal(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(_normal(row[i]) for i in order) for row in rows]
    return sorted(made, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def differences(spark, db, sf_dir: str, run, sql: str) -> list[str]:
    """Empty when both sides agree exactly."""
    df = run(spark, sf_dir)
    ours = _rows([tuple(r) for r in df.collect()], df.columns)
    result = db.sql(sql)
    theirs = _rows(result.fetchall(), result.columns)
    found = []
    if sorted(df.columns) != sorted(result.columns):
        found.append(f"columns {sorted(df.columns)} != {sorted(result.columns)}")
    elif len(ours) != len(theirs):
        found.append(f"rows {len(ours)} != {len(theirs)}")
    else:
        bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
        if bad:
            found.append(f"{len(bad)} rows differ, first {bad[0][0]} != {bad[0][1]}")
    return found


if __name__ == "__main__":
    import sys

    from pyspark.sql import SparkSession

    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    duck, sqls = connect(sf_dir), entry.oracle_sql()
    for key, run in entry.queries().items():
        if wanted and key not in wanted:
            continue
        begin = time.time()
        try:
            if key in sqls:
                problems = differences(session, duck, sf_dir, run, sqls[key])
            else:
                problems = [] if run(session, sf_dir).collect() else ["no rows"]
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        kind = "S" if key in sqls else "R"
        state = "FAIL" if problems else "ok  "
        print(f"{state} {kind} {key} {time.time() - begin:.1f}s", *problems, flush=True)
