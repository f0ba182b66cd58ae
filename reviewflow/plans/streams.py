"""Stream queries: each works off a table as a stream and reads back what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewflow.functions.text import email_hash
from reviewflow.operators.scan import classify_rules
from reviewflow.plans.ingest import DUCK_ADMIT, DUCK_INTAKE, IGNORE, KEYWORDS, copied_mails, raw_mails
from reviewflow.plans.lifecycle import DUCK_WORKFLOW
from reviewflow.plans.registry import query, rounded
from reviewflow.plans.review import DURATIONS_SQL, node_marks
from reviewflow.session import scratch_dir
from reviewflow.sources.driver_tables import BASE, Tables
from reviewflow.sources.mail import mail_stream
from reviewflow.streaming import ingest as si
from reviewflow.streaming import live
from reviewflow.streaming import sessions as ss
from reviewflow.streaming.runs import current, finish, to_files


class StreamTables(Tables):
    """The same tables with the driver files read as streams."""

    def _build(self, name):
        if name in BASE:
            return self.spark.readStream.schema(BASE[name]).parquet(f"{self.path}/{name}.parquet*")
        return _retyped(super()._build(name), "timestamp_ntz", "timestamp")


def _retyped(df, old: str, new: str):
    """Event time must be ``timestamp``; the driver tables and the comparison use the other."""
    return df.select(*[F.col(c).cast(new).alias(c) if kind == old else F.col(c)
                       for c, kind in df.dtypes])


def streams(t) -> StreamTables:
    return StreamTables(t.spark, t.path)


def written(t, stream):
    path = scratch_dir(t.spark, "stream")
    finish(to_files(stream, path, trigger=None))
    rows = t.spark.read.schema(stream.schema).parquet(f"{path}/rows")
    return _retyped(rows, "timestamp", "timestamp_ntz")


def mail_files(t, parts: int = 4):
    """The raw feed as JSON files, in ``parts`` polls."""
    path = scratch_dir(t.spark, "feed")
    raw_mails(t).withColumn("received_at", F.col("received_at").cast("timestamp")) \
        .repartition(parts, "message_id").write.json(path)
    return path


query("s6_mail_stream", """
    SELECT CAST(message_id AS VARCHAR) AS message_id, received_at, body
    FROM (SELECT * REPLACE (CASE WHEN message_id % 11 = 0 THEN NULL WHEN message_id % 13 = 0
            THEN '' ELSE body END AS body) FROM mails)""")(
    lambda t: written(t, mail_stream(t.spark, mail_files(t), 1)).select(
        "message_id", "received_at", "body"))


def classified(mails):
    """Stands for the work on a mail: a rule label, an error for mail without subject."""
    labelled = classify_rules(mails, (("Accepted", ("the of",)),), "body")
    return labelled.select("session_id", "label", F.when(
        F.col("subject") == "(No Subject)", "no subject").alias("error"))


def ingested(t):
    path = scratch_dir(t.spark, "ingest")
    feed = mail_stream(t.spark, mail_files(t), 1)
    finish(si.run_ingest(feed, path, classified, KEYWORDS, IGNORE, trigger=None))
    opened = si.session_log(t.spark, path).filter("step = 0").groupBy("id") \
        .agg(F.max("email_content").alias("email_content"))
    return si.current_sessions(t.spark, path).drop("email_content").join(opened, "id")


# Copies of a mail differ only in what the hash leaves out, so any of them gives the same session,
# except that a failed copy is retried until one succeeds.
query("t1_run_ingest", f"""
    SELECT email_hash, max(status) FILTER (status = 'completed') IS NOT NULL AS completed,
        any_value(body) AS email_content, any_value(sender_email) AS sender_email
    FROM (SELECT sha256(body || '|' || sender_email) AS email_hash, body, sender_email,
            CASE WHEN subject = '(No Subject)' THEN 'failed' ELSE 'completed' END AS status
          FROM ({DUCK_INTAKE})) GROUP BY 1""")(
    lambda t: ingested(t).select("email_hash", (F.col("status") == "completed").alias("completed"),
                                 "email_content", "sender_email"))


def copied_stream(t):
    return copied_mails(streams(t)).withColumn(
        "message_id", F.col("message_id").cast("string"))


query("t2_dedupe_stream", "SELECT CAST(message_id AS VARCHAR) AS message_id, body FROM mails")(
    lambda t: written(t, si.dedupe_stream(copied_stream(t)).select("message_id", "body")))

query("t3_session_state", f"""
    SELECT email_hash, CAST(message_id AS VARCHAR) AS message_id, received_at, copies,
        'new' AS decision, 'processing' AS status FROM ({DUCK_ADMIT})""")(
    lambda t: decisions(t).withColumn("message_id", F.col("message_id").cast("long").cast("string")))


def decisions(t):
    path = scratch_dir(t.spark, "decisions")
    mails = streams(t)["mails"].select(F.lpad(F.col("message_id").cast("string"), 12, "0").alias("message_id"),
                                       "body", "sender_email", "received_at")
    finish(ss.session_state(mails, path, trigger=None))
    return _retyped(t.spark.read.parquet(f"{path}/rows"), "timestamp", "timestamp_ntz")



def live_state(t):
    path = scratch_dir(t.spark, "workflow")
    finish(live.workflow_stream(in_polls(t, t["quality_feedback"], "created_at"), path, trigger=None))
    return live.live_workflows(t.spark, t["email_workflows"], path)


query("t4_workflow_stream", DUCK_WORKFLOW)(live_state)


def in_polls(t, df, time_col: str, polls: int = 4):
    """``df`` as a stream of some polls in the order of time, rows without a time in the first.

    Every poll is written as the same number of files, and the stream takes that many at once.
    """
    path = scratch_dir(t.spark, "polls")
    files = t.spark.sparkContext.defaultParallelism
    df = _retyped(df, "timestamp_ntz", "timestamp")
    low, high = df.agg(F.min(time_col), F.max(time_col)).first()
    if low is None:
        polls = 1
    for n in range(polls):
        part = df
        if n:
            part = part.filter(F.col(time_col) >= F.lit(low + n * (high - low) / polls))
        if n < polls - 1:
            before = F.col(time_col) < F.lit(low + (n + 1) * (high - low) / polls)
            part = part.filter(before if n else before | F.col(time_col).isNull())
        part.repartition(files).write.parquet(f"{path}/poll={n}")
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/poll=*")


def state_of(t, start, label: str):
    """The state that a folded stream leaves."""
    path = scratch_dir(t.spark, label)
    finish(start(path))
    return _retyped(current(t.spark, path), "timestamp", "timestamp_ntz")


def event_sessions(t):
    """Events as sessions: an error is a failed one."""
    return t["events"].select(F.col("ts").alias("processing_started_at"), F.when(
        F.col("event_type") == "error", "failed").otherwise("completed").alias("status"))


for _name, _hours, _step in (("t5_health_stream", 1, 5), ("t5_health_stream_day", 24, 60)):
    query(_name, f"""
        WITH slots AS (SELECT unnest(generate_series(
                (SELECT time_bucket(INTERVAL {_step} MINUTE, min(ts)) FROM events)
                    - INTERVAL {_hours} HOUR + INTERVAL {_step} MINUTE,
                (SELECT max(ts) FROM events), INTERVAL {_step} MINUTE)) AS window_start)
        SELECT window_start, window_start + INTERVAL {_hours} HOUR AS window_end,
            CAST(count(*) AS BIGINT) AS total,
            CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors,
            round_even(count(*) FILTER (event_type = 'error') / count(*) * 100, 1) AS error_rate
        FROM slots JOIN events ON ts >= window_start
            AND ts < window_start + INTERVAL {_hours} HOUR
        GROUP BY window_start""")(
        lambda t, length=f"{_hours} hours", step=f"{_step} minutes": live.health_windows(state_of(
            t, lambda path: live.health_stream(
                in_polls(t, event_sessions(t), "processing_started_at"), path, step=step, trigger=None),
            "health"), length, step))


def streamed_durations(t):
    path = scratch_dir(t.spark, "durations")
    finish(live.node_duration_stream(in_polls(t, node_marks(t), "at"), path, trigger=None))
    return _retyped(live.streamed_durations(t.spark, path), "timestamp", "timestamp_ntz")


query("t6_node_duration_stream", DURATIONS_SQL)(streamed_durations)

query("t7_drop_late", """
    SELECT event_id, ts FROM events WHERE floor(value * 10) <= 300""")(
    lambda t: written(t, live.drop_late(
        streams(t)["events"].withColumn("_at", F.expr("ts + make_interval(0,0,0,0,0,0, floor(value * 10))")),
        "ts", F.col("_at")).select("event_id", "ts")))

query("t8_feedback_stream", """
    SELECT CAST(created_at AS DATE) AS feedback_date, count(*) AS total_feedback,
        avg(human_rating) AS avg_rating,
        count(*) FILTER (human_action = 'approved') AS approved_count,
        count(*) FILTER (human_action = 'edited') AS edited_count,
        count(*) FILTER (human_action = 'rejected') AS rejected_count,
        round(avg(final_quality_score), 6) AS avg_quality_score
    FROM quality_feedback GROUP BY 1""")(
    lambda t: rounded(live.feedback_days(state_of(t, lambda path: live.feedback_stream(
        in_polls(t, t["quality_feedback"], "created_at"), path, trigger=None), "feedback")),
        "avg_quality_score"))

query("t7_late_counts", """
    SELECT date_trunc('hour', ts) AS hour, count(*) AS events,
        count(*) FILTER (floor(value * 10) > 300) AS late
    FROM events GROUP BY 1""")(
    lambda t: live.late_counts(
        t["events"].withColumn("_at", F.expr("ts + make_interval(0,0,0,0,0,0, floor(value * 10))")),
        "ts", F.col("_at")).withColumn("hour", F.col("hour").cast("timestamp_ntz")))


def late_metrics(t):
    path = scratch_dir(t.spark, "late")
    seen = t["events"].withColumn("_at", F.expr("ts + make_interval(0,0,0,0,0,0, floor(value * 10))"))
    finish(live.drop_late_stream(in_polls(t, seen, "ts"), "ts", path, F.col("_at"), trigger=None))
    return t.spark.read.parquet(f"{path}/metrics").groupBy("metric_name").agg(
        F.sum("metric_value").alias("metric_value"))


query("t7_late_metrics", """
    SELECT unnest(['late_events_read', 'late_events_kept', 'late_events_dropped']) AS metric_name,
        CAST(unnest([count(*), count(*) FILTER (floor(value * 10) <= 300),
            count(*) FILTER (NOT floor(value * 10) <= 300)]) AS DOUBLE) AS metric_value FROM events""")(late_metrics)
