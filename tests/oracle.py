"""Compare registered queries with their SQL on DuckDB: python tests/oracle.py [sf_dir] [names...]"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir):
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows), sorted(columns)


def compare(spark, con, name, sf_dir):
    frame = entry.queries()[name](spark, sf_dir)
    ours = normal([tuple(row) for row in frame.collect()], frame.columns)
    result = con.execute(entry.oracle_sql()[name])
    theirs = normal(result.fetchall(), [c[0] for c in result.description])
    return ours, theirs


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    for name in sys.argv[2:] or entry.queries():
        started = time.time()
        ours, theirs = compare(spark, con, name, sf_dir)
        verdict = "ok" if ours == theirs else "DIFFERENT"
        print(f"{verdict:10} {name:22} {len(ours[0]):8} rows {time.time() - started:6.2f} s", flush=True)
        if ours != theirs:
            print(ours[1], theirs[1], len(theirs[0]), ours[0][:2], theirs[0][:2], sep="\n   ")
