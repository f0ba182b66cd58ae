"""Live workflow state, health and feedback figures."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reviewflow.operators.ingest import FRESH_SECONDS
from reviewflow.operators.sessions import durations_of, paired_marks
from reviewflow.operators.workflow import FEEDBACK_STATES, _advance
from reviewflow.session import delete_dir, make_dir
from reviewflow.sources.keyed import KeyedTable
from reviewflow.streaming.runs import POLL, counted, to_batches

STEP = "5 minutes"


# Kept beside a workflow: the action that its state comes from, so that an older one that comes late changes nothing.
ACTED = ("acted_at", "acted_id")


def workflow_stream(feedback: DataFrame, path: str, trigger: str | None = POLL):
    """Log the last effective action of each session of a poll.

    No state is kept: the last of the last actions is the last. A poll reads and writes its own rows alone;
    ``settle_workflows`` takes logged polls into a kept table and deletes them.
    """
    def poll(rows: DataFrame, batch_id: int) -> None:
        newest = F.max(F.struct("created_at", "id", "human_action")).alias("_last")
        rows.filter(F.col("human_action").isin(*FEEDBACK_STATES)).groupBy("session_id").agg(newest) \
            .select("session_id", "_last.*").write.mode("overwrite").parquet(f"{path}/actions/batch_id={batch_id}")

    return to_batches(feedback, poll, path, trigger)


def _advanced(workflows: DataFrame, actions: DataFrame) -> DataFrame:
    """Workflow rows after the logged actions that are newer than those they come from."""
    newest = actions.groupBy(F.col("session_id").alias("_session")).agg(
        F.max(F.struct("created_at", "id", "human_action")).alias("_newest"))
    if not set(ACTED) <= set(workflows.columns):
        last = newest.select("_session", F.col("_newest.human_action").alias("_last"))
        return _advance(workflows, last, FEEDBACK_STATES, ["workflow_state", "current_step"])
    acted = F.struct(F.col("acted_at").alias("created_at"), F.col("acted_id").alias("id"))
    later = F.col("acted_at").isNull() | (F.struct("_newest.created_at", "_newest.id") > acted)
    last = workflows.join(newest, F.col("session_id") == F.col("_session")).where(later).select(
        "_session", F.col("_newest.human_action").alias("_last"), F.col("_newest.created_at").alias("_at"),
        F.col("_newest.id").alias("_id"))
    stated = _advance(workflows, last.select("_session", "_last"), FEEDBACK_STATES,
                      ["workflow_state", "current_step"])
    times = last.select(F.col("_session").alias("_of"), "_at", "_id")
    return stated.join(times, F.col("session_id") == F.col("_of"), "left").select(*[
        F.coalesce("_at" if c == "acted_at" else "_id", c).alias(c) if c in ACTED else F.col(c)
        for c in workflows.columns])


def live_workflows(spark: SparkSession, workflows: DataFrame, path: str) -> DataFrame:
    """Workflow rows after everything logged so far; equals the batch operator on the whole log.

    ``workflows`` with the columns ``ACTED`` may have taken in some of the actions before.
    """
    return _advanced(workflows, spark.read.parquet(f"{path}/actions"))


def settle_workflows(table: KeyedTable, path: str) -> list[int]:
    """Take all logged polls but the newest into the kept workflows, then delete them; returns their numbers.

    The table has the columns ``ACTED``, null at first. Only the folders of sessions with an action are read and
    written. Polls that are taken in again, after a failure, change nothing.
    """
    log = table.spark.read.parquet(f"{path}/actions")
    polls = sorted(r[0] for r in log.select("batch_id").distinct().collect())[:-1]
    if polls:
        old = log.where(F.col("batch_id").isin(polls)).drop("batch_id")
        table.rewrite(old.select("session_id"), lambda rows: _advanced(rows, old))
    for n in polls:
        delete_dir(table.spark, f"{path}/actions/batch_id={n}")
    return polls


def health_stream(sessions: DataFrame, path: str, time_col: str = "processing_started_at",
                  step: str = STEP, trigger: str | None = POLL):
    """Keep rows and failures per ``step``. Late rows are added to their step; none is dropped."""
    def count(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col(time_col).isNotNull()).groupBy(F.window(time_col, step).start.alias("step")) \
            .agg(F.count("*").alias("total"), F.count_if(F.col("status") == "failed").alias("errors"))

    return counted(sessions, count, ["step"], path, trigger)


def health_windows(steps: DataFrame, length: str = "1 hour", step: str = STEP) -> DataFrame:
    """Rows, failures and error rate of every ``length`` window that has rows, moved on by ``step``, the
    running ones included. Only the small step counts are repeated over their windows."""
    windows = steps.groupBy(F.window("step", length, step)).agg(
        F.sum("total").alias("total"), F.sum("errors").alias("errors"))
    return windows.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "total", "errors", F.bround(F.col("errors") / F.col("total") * 100, 1).alias("error_rate"))


def feedback_stream(feedback: DataFrame, path: str, trigger: str | None = POLL):
    """Keep counts and sums per day. Late rows are added to their day; none is dropped."""
    acted = lambda a: F.count_if(F.col("human_action") == a).alias(f"{a}_count")

    def count(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.to_date("created_at").alias("feedback_date")).agg(
            F.count("*").alias("total_feedback"), F.count("human_rating").alias("ratings"),
            F.sum("human_rating").alias("rating_sum"), acted("approved"), acted("edited"), acted("rejected"),
            F.count("final_quality_score").alias("scores"), F.sum("final_quality_score").alias("score_sum"))

    return counted(feedback, count, ["feedback_date"], path, trigger)


def feedback_days(days: DataFrame) -> DataFrame:
    """Daily feedback totals, the running day included."""
    return days.select(
        "feedback_date", "total_feedback", (F.col("rating_sum") / F.col("ratings")).alias("avg_rating"),
        "approved_count", "edited_count", "rejected_count",
        (F.col("score_sum") / F.col("scores")).alias("avg_quality_score"))


def node_duration_stream(marks: DataFrame, path: str, trigger: str | None = POLL, limit: str | None = None):
    """Durations as the end marks arrive, by the same pairing as ``node_durations``.

    Starts that wait for their end are the state. They wait however long, or ``limit`` behind the latest mark
    if the caller gives one (an interval); those given up are written under ``given_up``. Marks of a run are
    expected in the order of time over polls; within a poll they are put in order. All marks of a poll are paired
    once and written once, durations and starts apart.
    """
    names = ["session_id", "node_name", "run", "mark", "at", "success"]

    def poll(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        known = rows.select(*names)
        if batch_id:
            known = known.unionByName(spark.read.schema(known.schema).parquet(
                f"{path}/state/batch_id={batch_id - 1}/kind=waiting"))
        ended = (F.col("mark") == "end") & (F.col("_before") == "start")
        waiting = (F.col("mark") == "start") & F.col("_after").isNull()
        latest = F.lit(None) if limit is None else rows.agg(F.max("at")).scalar() - F.expr(f"INTERVAL {limit}")
        kind = F.when(ended, "ended").when(waiting & (F.col("at") < latest), "given_up").when(waiting, "waiting")
        paired_marks(known).select(*names, "_since", kind.alias("kind")).filter("kind IS NOT NULL") \
            .write.mode("overwrite").partitionBy("kind").parquet(f"{path}/state/batch_id={batch_id}")
        for n in ("ended", "waiting"):
            make_dir(spark, f"{path}/state/batch_id={batch_id}/kind={n}")
        if batch_id:
            delete_dir(spark, f"{path}/state/batch_id={batch_id - 1}/kind=waiting")

    return to_batches(marks, poll, path, trigger)


def streamed_durations(spark: SparkSession, path: str) -> DataFrame:
    """The durations that ``node_duration_stream`` has found so far."""
    return durations_of(spark.read.parquet(f"{path}/state").filter("kind = 'ended'"))


def late_counts(events: DataFrame, time_col: str, arrived: Column | None = None,
                seconds: int = FRESH_SECONDS) -> DataFrame:
    """Events and how many of them ``drop_late`` leaves out, by the hour of their time."""
    kept = drop_late(events.withColumn("_row", F.lit(True)), time_col, arrived, seconds)
    hour = F.date_trunc("hour", time_col)
    return events.groupBy(hour.alias("hour")).agg(F.count("*").alias("events")).join(
        kept.groupBy(hour.alias("hour")).agg(F.count("*").alias("_kept")), "hour", "left") \
        .select("hour", "events", (F.col("events") - F.coalesce("_kept", F.lit(0))).alias("late"))


def drop_late_stream(events: DataFrame, time_col: str, path: str, arrived: Column | None = None,
                     seconds: int = FRESH_SECONDS, trigger: str | None = POLL):
    """Write the events in time under ``rows`` and what was read, kept and dropped under ``metrics``.

    The counts are observed while a poll is written, not worked out again; ``metrics`` has the columns of
    ``system_metrics``. A repeated poll writes the same folders.
    """
    def poll(rows: DataFrame, batch_id: int) -> None:
        seen, kept = Observation(), Observation()
        read = rows.observe(seen, F.count(F.lit(1)).alias("n"))
        drop_late(read, time_col, arrived, seconds).observe(kept, F.count(F.lit(1)).alias("n")) \
            .write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")
        n, left = seen.get["n"], kept.get["n"]
        figures = {"late_events_read": n, "late_events_kept": left, "late_events_dropped": n - left}
        tags = json.dumps({"batch_id": batch_id, "seconds": seconds})
        rows.sparkSession.createDataFrame(
            [(f"{name}-{batch_id}", name, float(v), "events", tags) for name, v in figures.items()],
            "id STRING, metric_name STRING, metric_value DOUBLE, metric_unit STRING, tags STRING") \
            .withColumn("timestamp", F.current_timestamp()).coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/metrics/batch_id={batch_id}")

    return to_batches(events, poll, path, trigger)


def drop_late(events: DataFrame, time_col: str, arrived: Column | None = None,
              seconds: int = FRESH_SECONDS) -> DataFrame:
    """Events whose time lies within ``seconds`` of their arrival, before or after.

    ``arrived`` is the arrival time, by default the time of the poll. No state is kept.
    """
    now = F.current_timestamp() if arrived is None else arrived
    whole = lambda c: F.unix_seconds(c.cast("timestamp"))
    return events.filter(F.abs(whole(now) - whole(F.col(time_col))) <= seconds)
