"""Run registered queries in Spark and their SQL in DuckDB and compare whole results.

    python tests/oracle_check.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def spark_session():
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[8]").appName("reviewflow-check")
             .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, Decimal):
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_plain(x) for x in v) + "]"
    return str(v)


KINDS = {"long": "bigint", "int": "integer", "integer": "integer", "string": "varchar",
         "timestamp_ntz": "timestamp", "float": "float", "double": "double", "date": "date",
         "boolean": "boolean", "bigint": "bigint"}


def compare(spark, con, sf_dir, fn, sql):
    start = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.select(*[df[c] for c in cols]).collect()
    took = time.time() - start
    if sql is None:
        return took, len(rows), "no sql"
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return took, len(rows), f"columns {cols} / {sorted(rel.columns)}"
    odd = [(c, types[c], str(ty)) for c, ty in zip(rel.columns, rel.types)
           if KINDS.get(types[c], types[c]) != str(ty).lower()]
    order = [rel.columns.index(c) for c in cols]
    got = sorted(tuple(_plain(v) for v in r) for r in rows)
    want = sorted(tuple(_plain(r[i]) for i in order) for r in rel.fetchall())
    if got != want:
        only = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return took, len(rows), f"values differ: {len(got)} / {len(want)} rows {str(only)[:900]}"
    return took, len(rows), f"ok{' types ' + str(odd) if odd else ''}"


def main():
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:]
    spark, con = spark_session(), duck(sf_dir)
    sql, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            took, n, verdict = compare(spark, con, sf_dir, fn, sql.get(name))
        except Exception as e:  # report and go on
            took, n, verdict = 0, 0, "error " + str(e)[:700]
        if not verdict.startswith("ok") or verdict != "ok" or n == 0:
            bad += 1
        print(f"{name:32s} {n:7d} rows {took:6.2f}s {verdict}", flush=True)
    print("not clean:", bad)


if __name__ == "__main__":
    main()
