"""Median seconds of warm runs of every query with SQL, in Spark and in DuckDB on as many threads: rows of a Markdown table."""

import statistics
import sys
import time

import duckdb

sys.path[:0] = ["/root/repo", "/root/repo/tests"]

from compare import TABLES  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from pressgauge.session import get_spark  # noqa: E402


def median(run, times=2):
    run()
    took = []
    for _ in range(times):
        t = time.time()
        run()
        took.append(time.time() - t)
    return statistics.median(took)


def main(d, cores=8):
    spark = get_spark("baseline", cores)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect(config={"threads": cores})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sorted(oracles):
        a = median(lambda: queries[name](spark, d).write.format("noop").mode("overwrite").save())
        began = time.time()
        con.execute(oracles[name]).fetchall()
        b = time.time() - began
        b = median(lambda: con.execute(oracles[name]).fetchall()) if b < 3 else b
        print(f"| {name} | {a:.2f} | {b:.2f} |", flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
