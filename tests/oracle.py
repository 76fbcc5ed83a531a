"""Run registered queries on Spark and their SQL twins on DuckDB, and compare."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None:
            return "~"
        if isinstance(v, float):
            if math.isnan(v):
                return "nan"
            return f"{v + 0.0:.9g}"
        return str(v)

    return sorted("|".join(cell(r[i]) for i in order) for r in rows)


def compare(name, spark_df, con, sql):
    t0 = time.time()
    got = [tuple(r) for r in spark_df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    want = cur.fetchall()
    t2 = time.time()
    names = [d[0] for d in cur.description]
    a, b = canon(got, spark_df.columns), canon(want, names)
    ok = sorted(spark_df.columns) == sorted(names) and a == b
    detail = ""
    if not ok:
        sa, sb = set(a), set(b)
        detail = f" only spark {sorted(sa - sb)[:3]} only sql {sorted(sb - sa)[:3]} cols {spark_df.columns} {names}"
    return ok, len(got), len(want), t1 - t0, t2 - t1, detail


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as E

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = E.queries(), E.oracle_sql()
    bad = 0
    total = time.time()
    for name, q in queries.items():
        if wanted and name not in wanted and not any(w.endswith("*") and name.startswith(w[:-1]) for w in wanted):
            continue
        try:
            t0 = time.time()
            df = q(spark, sf_dir)
            if name in oracle:
                ok, n, m, ts, td, detail = compare(name, df, con, oracle[name])
            else:
                n = len(df.collect())
                ok, m, ts, td, detail = n > 0, -1, time.time() - t0, 0, ""
            bad += not ok
            print(f"{'ok  ' if ok else 'FAIL'} {name:28s} rows {n}/{m} spark {time.time() - t0 - td:.1f}s sql {td:.1f}s{detail[:900]}", flush=True)
        except Exception as e:  # noqa: BLE001 - report and go on
            bad += 1
            print(f"FAIL {name:28s} {type(e).__name__}: {str(e)[:700]}", flush=True)
    print(f"{bad} failures, {time.time() - total:.0f}s")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
