"""Order-free comparison of a Spark result with DuckDB's, columns sorted by name."""

import math
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "∅"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(int(v)) if isinstance(v, bool) else str(v)


def rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in records)


def duck(d, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    cur = con.execute(sql)
    return rows(cur.fetchall(), [x[0] for x in cur.description])


def both(spark, d, query, sql):
    df = query(spark, d)
    return rows([tuple(r) for r in df.collect()], df.columns), duck(d, sql)


if __name__ == "__main__":
    sys.path[:0] = ["/root/repo", "/root/repo/tests"]
    import time

    import __spark_entry__ as e
    from pressgauge.session import get_spark

    spark = get_spark()
    spark.sparkContext.setLogLevel("ERROR")
    q, o = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or q:
        t = time.time()
        try:
            if name not in o:
                df = q[name](spark, sys.argv[1])
                print("rows", name, len(df.collect()), df.dtypes, f"{time.time() - t:.1f}s", flush=True)
                continue
            a, b = both(spark, sys.argv[1], q[name], o[name])
            same = a == b
            print("ok  " if same else "DIFF", name, len(a[1]), f"{time.time() - t:.1f}s", flush=True)
            if not same:
                print(a[0], b[0], len(a[1]), len(b[1]), [x for x in a[1] if x not in set(b[1])][:3], [x for x in b[1] if x not in set(a[1])][:3])
        except Exception as x:
            print("FAIL", name, str(x)[:600], flush=True)
