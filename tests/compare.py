"""Run registered queries beside their SQL in DuckDB: ``python tests/compare.py [names] [--sf 0.01]``."""

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; only got {list(set(got) - set(want))[:2]}; only want {list(set(want) - set(got))[:2]}"
    if got != want:
        extra, missing = set(got) - set(want), set(want) - set(got)
        return (
            f"{len(extra)} of {len(got)} rows differ; {sorted(names)}\n"
            f"  got  {sorted(extra, key=repr)[:2]}\n  want {sorted(missing, key=repr)[:2]}"
        )
    for a, b in zip(got, want):
        if [type(x) for x in a] != [type(x) for x in b]:
            return f"types {sorted(names)}\n  {a}\n  {b}"
    return None if got else "no rows"


if __name__ == "__main__":
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args.pop(args.index("--sf") + 1) if "--sf" in args else "0.01"
    names = [a for a in args if a != "--sf"]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, sf_dir, fn, sqls[name])
            else:
                n = fn(spark, sf_dir).count()
                problem = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)
