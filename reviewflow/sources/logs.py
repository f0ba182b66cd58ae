"""Reading and writing the log tables."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewflow.schemas import DAY, LOG_SCHEMAS, LOG_TIME, schema
from reviewflow.session import delete_dir, scratch_dir


def load_tables(spark: SparkSession, path: str, names=tuple(LOG_SCHEMAS)) -> dict[str, DataFrame]:
    """Log tables under ``path`` with their fixed schemas; logs carry their ``day`` partition."""
    tables = {}
    for name in names:
        fixed = schema(name)
        if name in LOG_TIME:
            fixed = fixed.add(DAY, "date")
        tables[name] = spark.read.schema(fixed).parquet(f"{path.rstrip('/')}/{name}")
    return tables


def run_query(spark: SparkSession, sql: str, args: dict | None = None, **views) -> DataFrame:
    """SQL with named markers over named DataFrames; values never become part of the text."""
    return spark.sql(sql, args=args or {}, **views)


def parse_json_col(df: DataFrame, col: str, json_schema: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, F.from_json(F.col(col), json_schema))


def append_log(df: DataFrame, path: str, table: str) -> None:
    """Append rows to a log, in day folders.

    Rows are rebalanced by day before the write: a small day becomes one file, a day with very many
    rows is split over tasks.
    """
    missing = [c for c in df.columns if c not in schema(table).fieldNames()]
    if missing:
        raise ValueError(f"not columns of {table}: {missing}")
    dated = df.withColumn(DAY, F.to_date(LOG_TIME[table]))
    dated.hint("rebalance", DAY).write.mode("append").partitionBy(DAY) \
         .parquet(f"{path.rstrip('/')}/{table}")


def drop_days(spark: SparkSession, path: str, edge: datetime, time_col: str) -> list[str]:
    """Delete the rows before ``edge`` from a log in day folders; returns the names of the deleted folders.

    Folders of earlier days are deleted whole, by name; that of the edge's own day is written anew without its
    earlier rows. Files of later days, and of rows without a day, are not touched.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.isDirectory())
    days = [n for n in names if re.fullmatch(rf"{DAY}=\d{{4}}-\d\d-\d\d", n)]
    edge_name = f"{DAY}={edge:%Y-%m-%d}"
    if edge_name in days:
        log = spark.read.parquet(path)
        day = log.filter(F.col(DAY) == F.lit(edge.date()))
        if not day.filter(F.col(time_col) < F.lit(edge).cast(log.schema[time_col].dataType)).isEmpty():
            kept = day.filter(F.col(time_col) >= F.lit(edge).cast(log.schema[time_col].dataType))
            at = scratch_dir(spark, "edge")
            kept.drop(DAY).write.parquet(at)
            kept = spark.read.parquet(at).withColumn(DAY, F.lit(edge.date()))
            delete_dir(spark, f"{path}/{edge_name}")
            kept.write.mode("append").partitionBy(DAY).parquet(path)
            delete_dir(spark, at)
    gone = [n for n in days if n < edge_name]
    for name in gone:
        delete_dir(spark, f"{path}/{name}")
    return gone


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write the next state of a table to a new folder and read it back from there."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, name: str, buckets: int, key: str = "session_id") -> DataFrame:
    """Save a log as a table bucketed and sorted by ``key``.

    Tables with the same number of buckets join on the key without a shuffle.
    """
    df.write.mode("errorifexists").bucketBy(buckets, key).sortBy(key).format("parquet") \
      .saveAsTable(name)
    return df.sparkSession.table(name)
