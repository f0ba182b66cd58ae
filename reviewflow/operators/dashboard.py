"""Dashboard figures: overview, timeline, classification, extraction, drafts, nodes, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewflow.functions.period import before, rate, within
from reviewflow.functions.scores import length_category
from reviewflow.operators.sessions import in_period

STARTED = "processing_started_at"


def rows() -> Column:
    return F.count(F.lit(1))


def overview(t, days: int = 7, as_of=None) -> DataFrame:
    done = F.col("status") == "completed"
    seen = within(t["email_sessions"], STARTED, as_of, days).agg(
        rows().alias("total_sessions"), F.count_if(done).alias("_done"),
        F.avg(F.when(done, F.col("total_duration_ms"))).alias("_ms"))
    return seen.select(
        "total_sessions", rate(F.col("_done"), F.col("total_sessions")).alias("success_rate"),
        F.bround(F.coalesce("_ms", F.lit(0.0)) / 1000, 2).alias("avg_processing_time"),
        F.lit(f"Last {days} days").alias("time_period"))


def label_counts(t, days: int = 7, as_of=None) -> DataFrame:
    return within(t["email_sessions"], STARTED, as_of, days) \
        .filter(F.col("classification").isNotNull()) \
        .groupBy("classification").agg(rows().alias("count"))


def timeline(t, hours: int = 24, as_of=None) -> DataFrame:
    return within(t["email_sessions"], STARTED, as_of, hours, "hours") \
        .select(STARTED, "total_duration_ms", "status", "classification", "sender_email") \
        .orderBy(F.desc_nulls_first(STARTED))


def timeline_summary(t, hours: int = 24, as_of=None) -> DataFrame:
    """One row, or none when the window is empty."""
    return within(t["email_sessions"], STARTED, as_of, hours, "hours").agg(
        rows().alias("total_processed"),
        F.bround(F.avg("total_duration_ms") / 1000, 2).alias("avg_time"),
        F.count_if(F.col("status") == "completed").alias("success_count")) \
        .filter(F.col("total_processed") > 0)


def classification_dist(t, days: int = 30, as_of=None) -> DataFrame:
    """Rows per label with the grand total; the window runs over the few grouped rows."""
    total = F.sum("count").over(Window.partitionBy())
    return in_period(t["classification_results"], t["email_sessions"], as_of, days) \
        .groupBy("predicted_label") \
        .agg(rows().alias("count"), F.avg("confidence_score").alias("avg_confidence")) \
        .withColumn("total_classifications", total).orderBy(F.desc("count"))


def classification_trend(t, days: int = 30, as_of=None) -> DataFrame:
    return in_period(t["classification_results"], t["email_sessions"], as_of, days) \
        .groupBy("date", "predicted_label").agg(rows().alias("count")).orderBy(F.desc("date"))


def extraction_stats(t, days: int = 30, as_of=None) -> DataFrame:
    stats = in_period(t["document_extractions"], t["email_sessions"], as_of, days).agg(
        rows().alias("total_attempts"), F.count_if("client_matched").alias("client_matches"),
        F.count_if("extraction_success").alias("successful_extractions"),
        F.avg("documents_found").alias("avg_docs_found"))
    return stats.withColumn(
        "success_rate", rate(F.col("successful_extractions"), F.col("total_attempts")))


def match_trend(t, days: int = 30, as_of=None) -> DataFrame:
    return in_period(t["document_extractions"], t["email_sessions"], as_of, days) \
        .groupBy("date").agg(rows().alias("total_attempts"),
                             F.count_if("client_matched").alias("matches")) \
        .orderBy(F.desc("date"))


def top_clients(t, n: int = 10) -> DataFrame:
    return t["document_extractions"] \
        .filter(F.col("client_matched") & F.col("client_name").isNotNull()) \
        .groupBy("client_name").agg(rows().alias("match_count")) \
        .orderBy(F.desc("match_count"), "client_name").limit(n)


def draft_stats(t, days: int = 30, as_of=None) -> DataFrame:
    used = F.col("context_used")
    stats = in_period(t["draft_generations"], t["email_sessions"], as_of, days).agg(
        rows().alias("total_drafts"), F.avg("draft_length").alias("avg_length"),
        F.avg("template_adherence_score").alias("avg_template_score"),
        F.count_if(used).alias("context_usage_count"),
        F.avg(F.when(used, F.col("context_length"))).alias("avg_context_length"))
    return stats.withColumn(
        "context_usage_rate", rate(F.col("context_usage_count"), F.col("total_drafts")))


def draft_trend(t, days: int = 30, as_of=None) -> DataFrame:
    return in_period(t["draft_generations"], t["email_sessions"], as_of, days) \
        .groupBy("date").agg(F.avg("template_adherence_score").alias("avg_quality"),
                             rows().alias("draft_count")) \
        .orderBy(F.desc("date"))


def length_hist(t, days: int = 30, as_of=None) -> DataFrame:
    return in_period(t["draft_generations"], t["email_sessions"], as_of, days) \
        .groupBy(length_category(F.col("draft_length")).alias("length_category")) \
        .agg(rows().alias("count"))


def node_stats(t, days: int = 7, as_of=None) -> DataFrame:
    return in_period(t["node_executions"], t["email_sessions"], as_of, days) \
        .groupBy("node_name").agg(
            rows().alias("executions"), F.avg("duration_ms").alias("avg_duration"),
            F.count_if("success").alias("successful"),
            F.count_if(~F.col("success")).alias("failed")) \
        .orderBy(F.desc_nulls_first("avg_duration"))


def node_trend(t, days: int = 7, as_of=None) -> DataFrame:
    return in_period(t["node_executions"], t["email_sessions"], as_of, days) \
        .groupBy("date", "node_name").agg(F.avg("duration_ms").alias("avg_duration")) \
        .orderBy(F.desc("date"))


def system_health(t, as_of=None) -> DataFrame:
    sessions = t["email_sessions"]
    last_hour = F.col(STARTED) > before(as_of, sessions, STARTED, 1, "hours")
    counts = sessions.agg(
        F.count_if(last_hour & (F.col("status") == "failed")).alias("_errors"),
        F.count_if(last_hour).alias("_recent"), rows().alias("total_sessions"),
        F.count_if(F.col(STARTED) > before(as_of, sessions, STARTED, 24, "hours")).alias("sessions_24h"))
    return counts.select(rate(F.col("_errors"), F.col("_recent")).alias("error_rate"),
                         "total_sessions", "sessions_24h")


# Success bands of a node, in per cent.
GOOD_ABOVE, WARN_ABOVE = 95, 85
SUBJECT_CHARS = 30


def _whole(x):
    """Nearest whole number, halves up."""
    return F.floor(x + F.lit(0.5))


def dashboard_cols(df: DataFrame, which: str) -> DataFrame:
    """Display columns for the extraction figures, node rows or session rows."""
    if which == "documents":
        per = lambda c: _whole(F.col(c) / F.greatest("total_attempts", F.lit(1)) * 100)
        return df.withColumn("client_match_rate", per("client_matches")) \
                 .withColumn("extraction_rate", per("successful_extractions"))
    if which == "nodes":
        share = _whole(F.col("successful") / F.col("executions") * 100)
        return df.select(
            "node_name", "executions", _whole(F.col("avg_duration")).alias("avg_ms"),
            share.alias("success_rate"),
            F.when(share > GOOD_ABOVE, "good").when(share > WARN_ABOVE, "warn")
             .otherwise("bad").alias("band"))
    if which != "sessions":
        raise ValueError(f"unknown display: {which}")
    ms, score = F.col("total_duration_ms"), F.col("template_adherence_score")
    return df.select(
        "id", STARTED, F.coalesce("sender_email", F.lit("-")).alias("sender"),
        F.when(F.coalesce("subject", F.lit("")) != "",
               F.concat(F.substring("subject", 1, SUBJECT_CHARS), F.lit("...")))
         .otherwise("-").alias("subject"),
        F.coalesce(F.nullif("classification", F.lit("")), F.lit("-")).alias("label"),
        F.when(F.coalesce(ms, F.lit(0)) != 0, F.concat(_whole(ms / 1000), F.lit("s")))
         .otherwise("-").alias("duration"),
        F.when(F.col("status") == "completed", "success").otherwise("danger").alias("badge"),
        F.concat(F.when(F.col("client_matched"), "✓ ").otherwise("✗ "),
                 F.coalesce("client_name", F.lit(""))).alias("client"),
        F.when(F.coalesce(score, F.lit(0.0)) != 0, F.concat(_whole(score * 100), F.lit("%")))
         .otherwise("-").alias("quality"))
