"""Run report and figures that the log columns imply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewflow.functions.period import hours_between
from reviewflow.operators.dashboard import rows


def run_report(results: DataFrame) -> DataFrame:
    """One row for a run: success, times, and how often each feature was used.

    ``results``: error, classification, rejection_type, processing_time, draft_generated,
    notice_sent, folder_found.
    """
    ok = F.col("error").isNull()
    share = lambda c: F.count_if(F.col(c))
    time = F.when(ok, F.col("processing_time"))
    return results.agg(
        rows().alias("total_tests"), F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        F.bround(F.count_if(ok) / F.greatest(rows(), F.lit(1)) * 100, 1).alias("success_rate"),
        F.avg(time).alias("avg_time"), F.min(time).alias("min_time"),
        F.max(time).alias("max_time"), share("draft_generated").alias("drafts_generated"),
        share("notice_sent").alias("notices_sent"), share("folder_found").alias("folders_found"))


def report_counts(results: DataFrame, column: str, default: str | None = None) -> DataFrame:
    """Rows without error per value; a missing value counts as ``default`` or not at all."""
    ok = results.filter(F.col("error").isNull())
    value = F.nullif(column, F.lit(""))
    if default is not None:
        value = F.coalesce(F.col(column), F.lit(default))
    return ok.select(value.alias(column)).filter(F.col(column).isNotNull()) \
             .groupBy(column).agg(rows().alias("count"))


def classification_accuracy(results: DataFrame) -> DataFrame:
    """Rows and share correct per predicted label."""
    return results.filter(F.col("human_verified_label").isNotNull()) \
        .groupBy("predicted_label").agg(
            rows().alias("verified"), F.count_if("is_correct").alias("correct")) \
        .withColumn("accuracy", F.bround(F.col("correct") / F.col("verified") * 100, 1))


def confusion(results: DataFrame) -> DataFrame:
    return results.filter(F.col("human_verified_label").isNotNull()) \
        .groupBy("predicted_label", "human_verified_label").agg(rows().alias("count"))


def metric_rollup(metrics: DataFrame) -> DataFrame:
    """Samples per metric, unit and hour."""
    hour = F.date_trunc("hour", F.col("timestamp")).cast("timestamp_ntz")
    unit = [c for c in ("metric_unit",) if c in metrics.columns]
    return metrics.groupBy("metric_name", *unit, hour.alias("hour")).agg(
        rows().alias("samples"), F.avg("metric_value").alias("avg_value"),
        F.min("metric_value").alias("min_value"), F.max("metric_value").alias("max_value"))


def time_to_review(drafts: DataFrame, feedback: DataFrame) -> DataFrame:
    """Hours from a session's first draft to its first human action.

    ``drafts``: session_id, created_at.
    """
    made = drafts.groupBy("session_id").agg(F.min("created_at").alias("drafted_at"))
    acted = feedback.groupBy(F.col("session_id").alias("_session")) \
                    .agg(F.min("created_at").alias("reviewed_at"))
    return made.join(acted, F.col("session_id") == F.col("_session")).select(
        "session_id", "drafted_at", "reviewed_at",
        hours_between(F.col("reviewed_at"), F.col("drafted_at")).alias("hours_to_review"))
