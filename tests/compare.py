"""Runs registered queries beside their SQL: python -m tests.compare SF_DIR [NAME...]."""

import os
import sys
import time
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    if isinstance(v, Decimal):
        return repr(float(v))
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    return repr(v)


def difference(df, con, text):
    """What differs between a frame and a query's result; empty if nothing does."""
    want = con.sql(text)
    if sorted(df.columns) != sorted(want.columns):
        return f"columns {sorted(set(df.columns) ^ set(want.columns))}"
    order = sorted(df.columns)
    a = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    b = sorted(tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall())
    if a != b:
        left, right = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return f"{len(a)} and {len(b)} rows; {order}: {left} against {right}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.getcwd())
    import __spark_entry__
    from candor.session import session

    spark = session(os.environ.get("COMPARE_MASTER", "local[8]"), **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(sys.argv[1]), 0
    known, told = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in sys.argv[2:] or known:
        began = time.time()
        try:
            df = known[name](spark, sys.argv[1])
            said = difference(df, con, told[name]) if name in told else f"no SQL, {df.count()} rows"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:400]}"
        print(f"{name}: {said[:700] or 'same'} ({time.time() - began:.1f} s)", flush=True)
