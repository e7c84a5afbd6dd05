"""Runs registered queries against their SQL twins on one table directory: python tests/compare.py DIR [NAME ...]."""

from __future__ import annotations

import math
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    if type(v).__name__ == "Decimal":
        return round(float(v), 4) + 0.0
    return v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def differs(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty if both sides agree, else what differs first."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; only here {[x for x in got if x not in want][:2]}; only there {[x for x in want if x not in got][:2]}" if len(got) < 3000 else f"{len(got)} and {len(want)} rows"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return "; ".join(f"{n}: {str(x)[:80]!r} and {str(y)[:80]!r}" for n, x, y in zip(sorted(names), a, b, strict=True) if x != y)
    return "" if got else "no rows"


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sys.argv[1])
    found, sqls = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or [n for n in found if n in sqls]:
        t = time.time()
        try:
            said = differs(spark, con, sys.argv[1], found[name], sqls[name])
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {said or 'ok'} ({time.time() - t:.1f} s)", flush=True)
