"""Compare registered queries with their DuckDB equivalents.

Usage: python tests/oracle_check.py [folder] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def ordered(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(row[i]) for i in at) for row in rows), key=repr)


def differences(df, con, sql):
    """Empty when both sides agree on column names, row count and values."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    expected = ordered(result.fetchall(), names)
    actual = ordered([tuple(r) for r in df.collect()], df.columns)
    if actual == expected:
        return []
    found = [f"rows {len(actual)} != {len(expected)}"] if len(actual) != len(expected) else []
    extra = set(map(repr, actual)) - set(map(repr, expected))
    missing = set(map(repr, expected)) - set(map(repr, actual))
    found.append(f"columns {sorted(names)}")
    found += [f"spark only: {r}" for r in sorted(extra)[:3]] + [f"sql only:   {r}" for r in sorted(missing)[:3]]
    return found


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="docketlens-check-")).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = contract.oracle_sql()
    bad = 0
    for name, query in contract.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in oracles:
                problems = differences(df, con, oracles[name])
                note = f"{df.count()} rows" if len(sys.argv) > 2 else "same"
            else:
                problems, note = [], f"{df.count()} rows, no SQL"
        except Exception as error:  # report and go on
            problems, note = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {note}", flush=True)
        for line in problems:
            print("     ", line[:1500])
    print(f"{bad} failing")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
