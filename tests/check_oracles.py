"""Run queries beside their SQL counterparts: python tests/check_oracles.py [folder] [query ...]"""
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from shelfdate.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(df):
    df = df[sorted(df.columns)]
    rows = [tuple("\0" if v is None or v is pd.NA or v != v else (int(v) if isinstance(v, bool) or (isinstance(v, float) or hasattr(v, "item")) and float(v).is_integer()
                  else v) for v in r) for r in df.astype(object).itertuples(index=False)]
    return sorted(map(str, rows)), list(df.columns)


def compare(spark, con, folder, name):
    t = time.time()
    got = entry.queries()[name](spark, folder).toPandas()
    took = time.time() - t
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"{took:6.1f}s rows-only {len(got)}", True
    a, ca = normal(got)
    b, cb = normal(con.execute(sql).df())
    if ca != cb:
        return f"{took:6.1f}s COLUMNS {ca} {cb}", False
    if a != b:
        left, right = sorted(set(a) - set(b))[:4], sorted(set(b) - set(a))[:4]
        return f"{took:6.1f}s DIFFERENT {len(a)} {len(b)} only spark {left} only sql {right}", False
    return f"{took:6.1f}s same {len(a)}", True


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session("check", master="local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "12g"})
    con = connect(folder)
    for name in names:
        try:
            print(f"{name:28s}", compare(spark, con, folder, name)[0], flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"{name:28s} ERROR {str(error)[:900]}", flush=True)
