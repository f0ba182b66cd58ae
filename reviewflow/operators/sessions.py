"""Session joins, closing and durations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewflow.functions.period import (as_of_column, before, hours_between, micros_between,
                                         within)
from reviewflow.operators.joins import HOT_ROWS, SENT_IDS, left_join_many, send_if_small

STARTED, COMPLETED = "processing_started_at", "processing_completed_at"
MAX_INT = 2**31 - 1


def in_period(fact: DataFrame, sessions: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """Fact rows of sessions started in the trailing window, with the session's start date.

    Only id and start date of the sessions in the window are joined. They are sent to the fact
    scan when they are few enough, so that the fact table is not shuffled.
    """
    recent = within(sessions, STARTED, as_of, days).select(
        F.col("id").alias("_session"), F.to_date(STARTED).alias("date"))
    return fact.join(send_if_small(recent), F.col("session_id") == F.col("_session")) \
               .drop("_session")


def _wanted(ids):
    """Ids to look up: None for all, a list, or the distinct first column of a DataFrame."""
    if isinstance(ids, DataFrame):
        return send_if_small(ids.select(F.col(ids.columns[0]).alias("_wanted")).distinct())
    if ids is None or (isinstance(ids, Iterable) and not isinstance(ids, str)):
        return ids
    return [ids]


def _pick(df: DataFrame, key: str, wanted) -> DataFrame:
    """Rows whose key is in ``wanted``."""
    if wanted is None:
        return df
    if isinstance(wanted, DataFrame):
        return df.join(wanted, F.col(key) == F.col("_wanted"), "left_semi")
    return df.filter(F.col(key).isin(list(wanted)))


def _attach(t, df: DataFrame, facts: list[tuple[str, list[str]]], wanted, hot_rows: int) -> DataFrame:
    """Left joins to the facts one after the other; the workflow holds one row per session."""
    for name, cols in facts:
        fact = _pick(t[name].select("session_id", *cols), "session_id", wanted)
        if name == "email_workflows":
            state = fact.withColumnRenamed("session_id", "_session")
            df = df.join(state, F.col("id") == F.col("_session"), "left").drop("_session")
        else:
            df = left_join_many(df, fact, "id", "session_id", hot_rows)
    return df


def session_summary(t, ids=None, one_row_per_session: bool = False,
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """Sessions with workflow, feedback, extraction and draft; matching rows multiply."""
    wanted = _wanted(ids)
    base = _pick(t["email_sessions"], "id", wanted).select(
        "id", "sender_email", "sender_name", "subject", "classification", "status", STARTED,
        COMPLETED, "total_duration_ms")
    facts = [("email_workflows", ["workflow_state", "current_step"]),
             ("quality_feedback", ["human_action", "human_rating"]),
             ("document_extractions", ["client_matched", "client_name"]),
             ("draft_generations", ["template_adherence_score"])]
    if "auto_quality_score" in t["draft_generations"].columns:
        facts[-1][1].append("auto_quality_score")
    if not one_row_per_session:
        return _attach(t, base, facts, wanted, hot_rows)
    for name, cols in facts:
        first = F.min(F.struct(*cols))
        fact = _pick(t[name], "session_id", wanted).groupBy("session_id").agg(first.alias("_first"))
        base = base.join(fact, F.col("id") == F.col("session_id"), "left") \
                   .select(*base.columns, *[F.col(f"_first.{c}").alias(c) for c in cols])
    return base


def session_detail(t, ids=None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every session column with classification, extraction, draft and feedback."""
    facts = [("classification_results", ["predicted_label", "confidence_score"]),
             ("document_extractions", ["client_matched", "documents_found"]),
             ("draft_generations", ["draft_length", "context_used", "draft_content",
                                    "final_draft_content"]),
             ("quality_feedback", ["human_action", "human_rating", "final_quality_score"])]
    wanted = _wanted(ids)
    return _attach(t, _pick(t["email_sessions"], "id", wanted), facts, wanted, hot_rows)


def recent_sessions(t, n: int = 50) -> DataFrame:
    """The n newest rows of sessions joined to their facts.

    A session gives at least one row, so the rows come from the n newest sessions. Those are taken
    first (at most n ids, hence the broadcast) and the facts are cut to them before the joins.
    """
    base = ["id", "sender_email", "sender_name", "subject", "classification", STARTED,
            "total_duration_ms", "status"]
    newest = t["email_sessions"].select(*base).orderBy(F.desc_nulls_first(STARTED), "id").limit(n)
    wanted = newest.select(F.col("id").alias("session_id"))
    wanted = F.broadcast(wanted) if n <= SENT_IDS else wanted
    rows = newest
    facts = [("classification_results", ["confidence_score"]),
             ("document_extractions", ["client_matched", "client_name"]),
             ("draft_generations", ["template_adherence_score", "context_used"])]
    extra = []
    for name, cols in facts:
        fact = t[name].select("session_id", *cols).join(wanted, "session_id", "left_semi") \
                      .withColumnRenamed("session_id", "_session")
        rows = rows.join(fact, F.col("id") == F.col("_session"), "left").drop("_session")
        extra += cols
    return rows.orderBy(F.desc_nulls_first(STARTED), "id",
                        *[F.asc_nulls_last(c) for c in extra]).limit(n)


# Fixed value: shown when a session has no draft.
NO_DRAFT = "No draft content available"


def review_card(t, ids=None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Session, draft and workflow for review; ``draft_text`` is the edited draft if any."""
    wanted = _wanted(ids)
    base = _pick(t["email_sessions"], "id", wanted).select(
        "id", "sender_email", "sender_name", "subject", "classification")
    facts = [("draft_generations", ["draft_content", "final_draft_content"]),
             ("email_workflows", ["workflow_state", "current_step"])]
    card = _attach(t, base, facts, wanted, hot_rows)
    shown = [F.nullif(c, F.lit("")) for c in ("final_draft_content", "draft_content")]
    return card.withColumn("draft_text", F.coalesce(*shown, F.lit(NO_DRAFT)))


def _pending(t) -> DataFrame:
    waiting = t["email_workflows"].filter(F.col("workflow_state") == "pending_review") \
        .select(F.col("session_id").alias("_session"), "workflow_state", "current_step")
    return t["email_sessions"].join(waiting, F.col("id") == F.col("_session"))


def pending_sessions(t) -> DataFrame:
    """Sessions waiting for review that have no feedback, oldest first."""
    waiting = _pending(t)
    ids = send_if_small(waiting.select(F.col("id").alias("_id")))
    answered = t["quality_feedback"].join(ids, F.col("session_id") == F.col("_id"), "left_semi") \
        .select(F.col("session_id").alias("_answered")).distinct()
    return waiting.join(answered, F.col("id") == F.col("_answered"), "left_anti") \
        .select("id", "sender_email", "subject", COMPLETED, "workflow_state", "current_step") \
        .orderBy(F.asc_nulls_last(COMPLETED))


def overdue_sessions(t, hours: int = 24, as_of=None) -> DataFrame:
    """Sessions waiting for review that completed more than ``hours`` ago, oldest first."""
    now = as_of_column(as_of, t["email_sessions"], STARTED)
    waited = hours_between(now, F.col(COMPLETED))
    return _pending(t) \
        .filter(F.col(COMPLETED) < before(as_of, t["email_sessions"], STARTED, hours, "hours")) \
        .select("id", "sender_email", "subject", COMPLETED, waited.alias("hours_pending")) \
        .orderBy(F.asc_nulls_last(COMPLETED))


def paired_marks(marks: DataFrame) -> DataFrame:
    """Every mark with the kind and time of the one before it in its run.

    At equal times a start comes before an end.
    """
    run = Window.partitionBy("session_id", "node_name", "run").orderBy("at", F.desc("mark"), "success")
    return marks.withColumns({"_before": F.lag("mark").over(run), "_since": F.lag("at").over(run),
                              "_after": F.lead("mark").over(run)})


def node_durations(marks: DataFrame) -> DataFrame:
    """Durations in ms from the start and end marks of node runs.

    ``marks``: session_id, node_name, run, mark ('start' or 'end'), at, success. An end belongs to the
    start right before it: a later start replaces an earlier one, and an end uses its start up. So an end
    without a start gives nothing, nor does a start without an end. A run of over 24 days gets the largest
    number of the 32-bit column.
    """
    return durations_of(paired_marks(marks).filter("mark = 'end' AND _before = 'start'"))


def durations_of(ended: DataFrame) -> DataFrame:
    """Durations from end marks with the time of their start, ``_since``."""
    return ended.select(
        "session_id", "node_name", "run", F.col("_since").alias("started_at"),
        F.col("at").alias("completed_at"), "success",
        F.least(F.floor(micros_between(F.col("at"), F.col("_since")) / 1000), F.lit(MAX_INT)).cast("int")
        .alias("duration_ms"))


def close_sessions(sessions: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """Close the sessions that have a result: duration, status and label.

    ``results``: session_id, label, error (one row per session). Others stay as they are. The
    duration column is a 32-bit number of ms, so a session open for over 24 days gets its maximum. Sessions
    that are kept as a ``KeyedTable`` are closed in the folders of the results alone (``rewrite``).
    """
    outcome = results.select(F.col("session_id").alias("_session"), F.struct("label", "error").alias("_result"))
    closed, error = F.col("_result").isNotNull(), F.nullif(F.col("_result.error"), F.lit(""))
    now = as_of_column(as_of, sessions, STARTED)
    new = {
        COMPLETED: now,
        "total_duration_ms": F.least(
            F.floor(micros_between(now, F.col(STARTED)) / 1000), F.lit(MAX_INT)).cast("int"),
        "status": F.when(error.isNull(), "completed").otherwise("failed"),
        "error_message": F.col("_result.error"),
        "classification": F.col("_result.label"),
    }
    return sessions.join(outcome, F.col("id") == F.col("_session"), "left").select(
        *[F.when(closed, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
          for c in sessions.columns])
