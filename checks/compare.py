"""Run registered queries next to their SQL and report differences.

Usage: python -m checks.compare FOLDER [NAME ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return f"float {value}"
    return int(value) if hasattr(value, "as_integer_ratio") and value == int(value) else str(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def connect(folder: str):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def main() -> int:
    from checks import load

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = load()
    con, bad = connect(str(Path(folder))), 0
    for name in queries:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = queries[name](spark, folder)
            rows = [tuple(r) for r in df.collect()]
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"{name:34} SPARK FAILED {str(error)[:400]}", flush=True)
            continue
        took = time.time() - start
        if name not in sql:
            print(f"{name:34} {len(rows):8} rows only {took:6.2f}s", flush=True)
            continue
        start = time.time()
        try:
            answer = con.execute(sql[name])
            columns = [d[0] for d in answer.description]
            expected = answer.fetchall()
        except Exception as error:
            bad += 1
            print(f"{name:34} SQL FAILED {str(error)[:400]}", flush=True)
            continue
        mine, theirs = bag(df.columns, rows), bag(columns, expected)
        same = mine == theirs and sorted(df.columns) == sorted(columns)
        bad += not same
        print(
            f"{name:34} {len(rows):8} {'same' if same else 'DIFFERENT'} {took:6.2f}s sql {time.time() - start:5.2f}s",
            flush=True,
        )
        if not same:
            print("   ", sorted(df.columns), sorted(columns), len(rows), len(expected))
            print("    only spark", list((mine - theirs).items())[:4])
            print("    only sql  ", list((theirs - mine).items())[:4])
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
