"""Run registered queries and their SQL side by side: python tests/compare.py [sf_dir] [name ...]."""

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return v + 0.0
    return v


def difference(spark_df, con, sql):
    """None if both give the same rows, else a short account of what differs."""
    names = sorted(spark_df.columns)
    mine = [tuple(_cell(r[n]) for n in names) for r in spark_df.collect()]
    cur = con.execute(sql)
    theirs_names = [d[0] for d in cur.description]
    if sorted(theirs_names) != names:
        return f"columns {names} != {sorted(theirs_names)}"
    at = [theirs_names.index(n) for n in names]
    theirs = [tuple(_cell(r[i]) for i in at) for r in cur.fetchall()]
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    order = lambda r: tuple((v is not None, str(type(v).__name__ == "str"), str(v)) for v in r)
    bad = [(a, b) for a, b in zip(sorted(mine, key=order), sorted(theirs, key=order)) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ, {names}: {bad[0][0]} != {bad[0][1]}"
    kinds = [
        (n, type(a).__name__, type(b).__name__)
        for n, col_a, col_b in zip(names, zip(*mine), zip(*theirs))
        for a, b in zip(col_a, col_b) if a is not None and type(a) is not type(b)
    ]
    return f"types differ {kinds[0]}" if kinds else None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            result = difference(df, con, oracles[name]) if name in oracles else f"no SQL, {df.count()} rows"
        except Exception as e:
            result = f"ERROR {type(e).__name__} {str(e)[:600]}"
        print(f"{name:30s} {time.time() - start:6.2f}s  {result or 'same'}", flush=True)


if __name__ == "__main__":
    main()
