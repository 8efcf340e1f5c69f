"""Compares a query with its SQL on one folder of tables. As a script: ``python tests/oracle.py SF_DIR [name ...]``."""

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet{'' if Path(f'{sf_dir}/{t}.parquet').is_file() else '/*.parquet'}'")
    return c


def plain(v):
    if v is None:
        return ("", "null")
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("n", float(v)) if abs(v) < 2**53 else ("n", v)
    if isinstance(v, float):
        return ("n", "nan" if math.isnan(v) else float(f"{v:.9g}"))
    if isinstance(v, (list, tuple)):
        return ("l", tuple(plain(x) for x in v))
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    if hasattr(v, "as_tuple"):
        return ("n", float(v))
    return ("s", str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql, sf_dir):
    """'' if both give the same rows, else what differs."""
    df = fn(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    other = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if mine == other:
        return ""
    a, b = set(mine), set(other)
    return f"{len(mine)} rows against {len(other)}; only in Spark: {list(a - b)[:2]}; only in SQL: {list(b - a)[:2]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as e

    spark = SparkSession.builder.master(f"local[{sys.argv[1]}]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, q, sql = connect(sys.argv[2]), e.queries(), e.oracle_sql()
    for name in sys.argv[3:] or q:
        t = time.time()
        try:
            said = compare(spark, con, q[name], sql[name], sys.argv[2]) if name in sql else f"(no SQL) {q[name](spark, sys.argv[2]).count()} rows"
        except Exception as x:
            said = f"{type(x).__name__}: {str(x).splitlines()[0][:400]}"
        print(f"{name} {time.time() - t:.1f}s", said or "ok", flush=True)
