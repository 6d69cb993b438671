"""Compare registered queries with their SQL on one scale: python tests/compare.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return repr(v)


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted(tuple(plain(r[i]) for i in at) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return rows_of(names, cur.fetchall())


def compare(df, con, sql) -> str:
    """'' when both give the same columns and rows, else what differs."""
    names, got = spark_rows(df)
    wanted_names, wanted = duck_rows(con, sql)
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    if got == wanted:
        return "" if got else "both empty"
    extra = sorted(set(got) - set(wanted))[:3]
    absent = sorted(set(wanted) - set(got))[:3]
    return f"rows {len(got)} vs {len(wanted)}; spark only {extra}; sql only {absent}"


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cores}]").appName("gridspark")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def main():
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            if name in oracles:
                df = fn(spark, sf_dir)
                t1 = time.time()
                out = compare(df, con, oracles[name])
            else:
                n = fn(spark, sf_dir).count()
                t1 = time.time()
                out = "" if n else "no rows"
        except Exception as e:  # noqa: BLE001
            t1, out = time.time(), f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(out)
        print(f"{'FAIL' if out else 'ok  '} {name} {time.time() - t0:.1f}s {'sql' if name in oracles else 'rows'} {out}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
