"""Compare each query with its SQL in DuckDB, as sorted rows."""

from __future__ import annotations

import math
import sys

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 5) if math.isfinite(v) else str(v)
    if hasattr(v, "as_tuple"):
        return float(v) if v % 1 else int(v)
    return v


def compare(spark, name, f, sql, d):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    con.execute("set threads to 4")
    df = f(spark, d)
    got = df.toPandas()
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns), (name, sorted(got.columns), sorted(want.columns))
    cols = sorted(got.columns)
    rows = [sorted(map(repr, (tuple(None if v is None or pd.isna(v) else plain(v) for v in r) for r in x[cols].astype(object).itertuples(index=False, name=None)))) for x in (got, want)]
    assert len(rows[0]) == len(rows[1]), (name, len(rows[0]), len(rows[1]))
    bad = [(a, b) for a, b in zip(*rows) if a != b]
    assert not bad, (name, len(bad), bad[:3])
    return len(rows[0])


if __name__ == "__main__":
    import time

    sys.path.insert(0, ".")
    from pyspark.sql import SparkSession

    from lamina.plans import catalogue

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sql = catalogue.oracle_sql()
    for name, f in catalogue.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            n = compare(spark, name, f, sql[name], sys.argv[1]) if name in sql else f"(no SQL) {len(f(spark, sys.argv[1]).collect())}"
            print("ok  ", name, n, round(time.time() - t, 1), flush=True)
        except Exception as e:
            print("FAIL", name, str(e)[:600].replace("\n", " "), flush=True)
