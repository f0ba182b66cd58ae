"""Starting streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewflow.session import LARGE_STATE, delete_dir

POLL = "60 seconds"


@contextmanager
def large_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state beside the heap and save it as changes (``LARGE_STATE``)."""
    before = {key: spark.conf.get(key, None) for key in LARGE_STATE}
    for key, value in LARGE_STATE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _triggered(writer, trigger: str | None):
    return writer.trigger(availableNow=True) if trigger is None \
        else writer.trigger(processingTime=trigger)


def to_files(stream: DataFrame, path: str, trigger: str | None = POLL) -> StreamingQuery:
    """Append a stream to Parquet files; ``trigger=None`` works off what is there and ends."""
    writer = stream.writeStream.format("parquet").outputMode("append") \
        .option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
    return _triggered(writer, trigger).start()


def to_batches(stream: DataFrame, fold: Callable[[DataFrame, int], None], path: str,
               trigger: str | None = POLL) -> StreamingQuery:
    """Hand every micro-batch to ``fold(rows, batch_id)``."""
    writer = stream.writeStream.foreachBatch(fold) \
        .option("checkpointLocation", f"{path}/checkpoint")
    return _triggered(writer, trigger).start()


#: Folders of a table of counts by period: a poll rewrites those of its periods.
PERIOD_BUCKETS = 16


def counted(stream: DataFrame, count: Callable[[DataFrame], DataFrame], period: list[str], path: str,
            trigger: str | None = POLL, buckets: int = PERIOD_BUCKETS) -> StreamingQuery:
    """Add up counts by period over all micro-batches.

    ``count(rows)`` gives one row for each period with figures that add up. The sums lie in ``buckets`` folders by
    the day of the period; a poll reads the folders of its own periods and writes them anew, so late rows change
    the folder of their closed period and no row is dropped. Each poll writes its folders under its own
    number and names the newest number of every folder; a repeated poll finds what the poll before left.
    """
    def poll(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        place = F.coalesce(F.pmod(F.unix_date(F.col(period[0]).cast("date")), F.lit(buckets)), F.lit(buckets))
        new = count(rows).withColumn("bucket", place.cast("int")).persist()
        try:
            touched = {r[0] for r in new.select("bucket").distinct().collect()}
            newest = _versions(spark, path, batch_id - 1) if batch_id else {}
            figures = [c for c in new.columns if c not in (*period, "bucket")]
            both = new
            for n in sorted({newest[b] for b in touched & newest.keys()}):
                of = [b for b in touched & newest.keys() if newest[b] == n]
                held = spark.read.schema(new.schema).parquet(f"{path}/rows/batch_id={n}")
                both = both.unionByName(held.filter(F.col("bucket").isin(of)))
            both.groupBy(*period, "bucket").agg(*[F.sum(c).alias(c) for c in figures]) \
                .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch_id={batch_id}")
        finally:
            new.unpersist()
        newest |= dict.fromkeys(touched, batch_id)
        spark.createDataFrame(list(newest.items()) or [], "bucket INT, version LONG").coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/versions/batch_id={batch_id}")
        # What the poll before still needed, a repeat of this one does as well; older folders can go.
        if batch_id > 1:
            before = _versions(spark, path, batch_id - 1)
            for b, n in _versions(spark, path, batch_id - 2).items():
                if before[b] != n:
                    delete_dir(spark, f"{path}/rows/batch_id={n}/bucket={b}")
            delete_dir(spark, f"{path}/versions/batch_id={batch_id - 2}")

    return to_batches(stream, poll, path, trigger)


def _versions(spark: SparkSession, path: str, batch_id: int) -> dict[int, int]:
    """The poll that wrote each folder last; at most as many entries as there are folders."""
    told = spark.read.schema("bucket INT, version LONG").parquet(f"{path}/versions/batch_id={batch_id}")
    return {r.bucket: r.version for r in told.collect()}


def current(spark: SparkSession, path: str) -> DataFrame:
    """The sums after the last poll of ``counted``."""
    last = spark.read.parquet(f"{path}/versions").agg(F.max("batch_id")).first()[0]
    newest = spark.read.parquet(f"{path}/versions/batch_id={last}").select(
        "bucket", F.col("version").alias("batch_id"))
    return spark.read.parquet(f"{path}/rows").join(F.broadcast(newest), ["bucket", "batch_id"], "left_semi") \
        .drop("bucket", "batch_id")


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
