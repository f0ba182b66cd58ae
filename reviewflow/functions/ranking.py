"""Numbering rows inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewflow.session import scratch_dir

# Rows numbered by one task, about.
ID_RUN = 1_000_000


def _place(df: DataFrame, by: str) -> Column:
    """A number in the order of ``by``: itself or its time."""
    kind = df.schema[by].dataType.simpleString()
    if kind.startswith(("timestamp", "date")):
        return F.unix_micros(F.col(by).cast("timestamp")).cast("double")
    return F.col(by).cast("double")


def _dealt(df: DataFrame, group: list[str], by: str, run: int) -> DataFrame:
    """The rows with their group and the number of the task that a sort deals them to."""
    at = scratch_dir(df.sparkSession, "runs")
    parts = max(1, -(-df.count() // run))
    df.repartitionByRange(parts, *group, by).withColumn("_group", F.struct(*group)) \
        .withColumn("_run", F.spark_partition_id().cast("long")).write.parquet(at)
    return df.sparkSession.read.parquet(at)


def number_in_group(df: DataFrame, group: list[str], by: str, out: str, run: int = ID_RUN,
                    after: DataFrame | None = None) -> DataFrame:
    """``row_number`` over ``group`` in the order of the unique ``by``, a number, time or text.

    One group may hold most rows, so the range of ``by`` is cut into runs, as many as the table has
    times ``run`` rows. A run is numbered by itself; the small table of run sizes gives each
    run its starting number. ``after`` (the group columns and ``last``) lets a group go on after a number.
    The rows are shuffled once, by group and run. Texts have no even range: their runs are those that a sort by
    group and text deals to the tasks from sampled values, so a common beginning does no harm; they are written
    once, since a second sort might deal otherwise.
    """
    if df.schema[by].dataType.simpleString() == "string":
        cut = _dealt(df, group, by, run)
    else:
        place = _place(df, by)
        low, high, n = df.agg(F.min(place), F.max(place), F.count("*")).first()
        width = max(((high or 0.0) - (low or 0.0)) / max(1, -(-n // run)), 1e-9)
        at = F.coalesce(F.floor((place - F.lit(low or 0.0)) / F.lit(width)), F.lit(-1).cast("long"))
        cut = df.withColumn("_group", F.struct(*group)).withColumn("_run", at)
    sizes = cut.groupBy("_group", "_run").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("_group").orderBy("_run") \
                    .rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_group").alias("_g"), F.col("_run").alias("_r"),
                          F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    if after is not None:
        last = after.select(F.struct(*group).alias("_known"), "last")
        starts = starts.join(last, F.col("_g") == F.col("_known"), "left") \
            .select("_g", "_r", (F.col("_start") + F.coalesce("last", F.lit(0))).alias("_start"))
    inside = Window.partitionBy("_group", "_run").orderBy(by)
    return cut.withColumn("_n", F.row_number().over(inside)) \
        .join(starts, (F.col("_group") == F.col("_g")) & (F.col("_run") == F.col("_r"))) \
        .select(*df.columns, (F.col("_start") + F.col("_n")).cast("int").alias(out))
