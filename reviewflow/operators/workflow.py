"""Workflow state, lifecycle and keyed updates. Every function returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewflow.functions.period import before, since_day
from reviewflow.functions.text import before_underscore
from reviewflow.operators.joins import send_if_small
from reviewflow.schemas import SESSION_CHILDREN

# State and step a new session starts in.
START_STATE, START_STEP = "processing", "email_classification"
START_ACTIONS = '{"available_actions": ["classify", "reject"]}'
# Feedback action -> state, step.
FEEDBACK_STATES = {
    "approved": ("approved", "ready_to_send"),
    "edited": ("edited", "pending_revision"),
    "rejected": ("rejected", "rejected"),
}
# Click -> state, step, next actions.
CLICK_STATES = {
    "approve": ("approved", "creating_gmail_draft",
                '{"available_actions": ["create_draft", "send_email"]}'),
    "reject": ("rejected", "rejected_by_human",
               '{"available_actions": ["reprocess", "archive"]}'),
    "rate": ("rated", "awaiting_action",
             '{"available_actions": ["approve", "edit", "reject"]}'),
}
# Review results that become the session's status.
STATUS_ACTIONS = ("approved", "rejected", "edited")
ARCHIVABLE = ("completed", "approved", "rejected")
# Rows of a child table that one task checks for removed sessions.
TASK_ROWS = 2_000_000


def start_workflows(new_sessions: DataFrame) -> DataFrame:
    """The first workflow row of each new session."""
    return new_sessions.select(
        F.col("id").alias("session_id"), F.lit(START_STATE).alias("workflow_state"),
        F.lit(START_STEP).alias("current_step"), F.lit(START_ACTIONS).alias("next_actions"))


def _lookup(key: Column, table: dict, place: int) -> Column:
    out = None
    for name, values in table.items():
        value = F.lit(values[place])
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out


def last_action(log: DataFrame, action: Column, allowed) -> DataFrame:
    """The latest effective action of each session; partial maxima keep hot sessions small."""
    kept = log.withColumn("_action", action).filter(F.col("_action").isin(*allowed))
    return kept.groupBy(F.col("session_id").alias("_session")) \
               .agg(F.max_by("_action", F.struct("created_at", "id")).alias("_last"))


def _advance(workflows: DataFrame, last: DataFrame, table: dict, columns: list[str]) -> DataFrame:
    joined = workflows.join(last, F.col("session_id") == F.col("_session"), "left")
    return joined.select(*[
        F.coalesce(_lookup(F.col("_last"), table, columns.index(c)), F.col(c)).alias(c)
        if c in columns else F.col(c) for c in workflows.columns])


def workflow_from_feedback(workflows: DataFrame, feedback: DataFrame) -> DataFrame:
    """Workflow rows after the feedback log; actions without a state change nothing."""
    last = last_action(feedback, F.col("human_action"), FEEDBACK_STATES)
    return _advance(workflows, last, FEEDBACK_STATES, ["workflow_state", "current_step"])


def workflow_from_clicks(workflows: DataFrame, clicks: DataFrame) -> DataFrame:
    """Workflow rows after the review clicks, with the next actions on offer."""
    if "next_actions" not in workflows.columns:
        workflows = workflows.withColumn("next_actions", F.lit(None).cast("string"))
    last = last_action(clicks, before_underscore(F.col("action_value")), CLICK_STATES)
    return _advance(workflows, last, CLICK_STATES,
                    ["workflow_state", "current_step", "next_actions"])


def status_from_review(sessions: DataFrame, actions: DataFrame) -> DataFrame:
    """Session status after the last approval, rejection or edit."""
    last = last_action(actions, F.col("human_action"), STATUS_ACTIONS)
    return sessions.join(last, F.col("id") == F.col("_session"), "left").select(*[
        F.coalesce("_last", c).alias(c) if c == "status" else F.col(c)
        for c in sessions.columns])


def touch(df: DataFrame, changed: Column, as_of, column: str = "updated_at") -> DataFrame:
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return df.withColumn(column, F.when(changed, now).otherwise(F.col(column)))


def drop_old(df: DataFrame, as_of=None, days: int = 90, time_col: str = "created_at") -> DataFrame:
    """Retention: rows of the last ``days`` days. A row exactly that old stays."""
    stamp, edge = F.col(time_col), before(as_of, df, time_col, days, "days")
    return since_day(df, time_col, edge, nulls=True).filter(stamp.isNull() | (stamp >= edge))


def archive(sessions: DataFrame, as_of=None, months: int = 6) -> DataFrame:
    edge = before(as_of, sessions, "processing_started_at", months, "months")
    old = (F.col("processing_completed_at") < edge) \
        & F.col("status").isin(*ARCHIVABLE)
    return sessions.withColumn("status", F.when(old, "archived").otherwise(F.col("status")))


def apply_updates(current: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Current table with ``columns`` taken from ``updates`` where the key has one.

    ``updates`` holds one row per key. An update to NULL counts as an update. The whole table is read and
    given back; a table that is kept as a ``KeyedTable`` takes updates into the folders they touch.
    """
    new = updates.select(F.col(key).alias("_key"), F.struct(*columns).alias("_new"))
    hit = F.col("_new").isNotNull()
    return current.join(new, F.col(key) == F.col("_key"), "left").select(*[
        F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in current.columns])


def cascade_delete(t, removed_ids: DataFrame) -> dict[str, DataFrame]:
    """Session children without the rows of removed sessions.

    Removed ids too many to send are dealt to so many tasks that each has at most about ``TASK_ROWS`` of them and of
    the child's rows; a task holds its ids and the rows stream past, so neither is sorted. Ids shrink so well in a
    shuffle that tasks joined by its bytes would hold tens of millions of rows.
    """
    ids = removed_ids.select(F.col(removed_ids.columns[0]).alias("_gone"))
    n = ids.count()

    def dealt(rows: int) -> DataFrame:
        return ids.repartition(max(1, -(-max(n, rows) // TASK_ROWS)), "_gone").distinct()

    gone = dealt(n)
    sent = send_if_small(gone)

    def without(df: DataFrame) -> DataFrame:
        known = dealt(df.count()).hint("shuffle_hash") if sent is gone else sent
        return df.join(known, F.col("session_id") == F.col("_gone"), "left_anti")

    return {name: without(t[name]) for name in SESSION_CHILDREN if name in t}
