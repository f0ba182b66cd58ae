"""Scan, source and sink queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from reviewflow.plans.registry import query
from reviewflow.schemas import DAY, LOG_SCHEMAS, LOG_TIME, schema
from reviewflow.session import scratch_dir
from reviewflow.sources import logs
from reviewflow.sources.driver_tables import COLUMNS, LOG_TABLES

def derived(name: str) -> list[tuple[str, str]]:
    """Names and types of the fixed schema's columns that the driver's tables fill."""
    return [(c, kind) for c, kind in re.findall(r"(\w+) ([A-Z]+(?:\(\d+,\d+\))?)", LOG_SCHEMAS[name])
            if c in COLUMNS[name]]


def stored(t, name: str):
    """The table written as its part of the log and read back with its fixed schema.

    These logs span years with a few rows a day, so they are written without folders per day; ``s4``
    appends by day.
    """
    path, rows = scratch_dir(t.spark, "tables"), t[name]
    fixed = rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema(name).fields])
    if name in LOG_TIME:
        fixed = fixed.withColumn(DAY, F.to_date(LOG_TIME[name]))
    fixed.write.parquet(f"{path}/{name}")
    back = logs.load_tables(t.spark, path, [name])[name]
    return back.select(*[
        F.col(c).cast("timestamp_ntz").alias(c) if kind == "TIMESTAMP" else F.col(c)
        for c, kind in derived(name)])


def _checked(name: str) -> str:
    casts = ", ".join(f"CAST({c} AS {kind}) AS {c}" for c, kind in derived(name))
    return f"SELECT {casts} FROM {name}"


for _table in LOG_TABLES:
    if _table in LOG_SCHEMAS:
        query(f"s1_{_table}", _checked(_table))(lambda t, name=_table: stored(t, name))
query("s1_mails", "SELECT * FROM mails")(lambda t: t["mails"])
# Vectors are compared by whole numbers made of all their elements.
query("s1_email_threads", """
    SELECT vec_id, email_thread, len(embedding) AS size, CAST(list_sum(list_transform(embedding,
        lambda x, i: CAST(floor(CAST(x AS DOUBLE) * 1000000) AS BIGINT) * i)) AS BIGINT) AS elements
    FROM email_threads""")(
    lambda t: t["email_threads"].select(
        "vec_id", "email_thread", F.size("embedding").cast("long").alias("size"),
        F.aggregate(F.transform("embedding", lambda x, i: F.floor(x.cast("double") * 1000000) * (i + 1)),
                    F.lit(0).cast("long"), lambda total, x: total + x).alias("elements")))

query("s2_run_query", """
    SELECT status, count(*) AS sessions FROM email_sessions
    WHERE processing_started_at > TIMESTAMP '2000-01-01' AND status <> 'failed' GROUP BY status""")(
    lambda t: logs.run_query(t.spark, """
        SELECT status, count(*) AS sessions FROM {sessions}
        WHERE processing_started_at > CAST(:since AS TIMESTAMP_NTZ) AND status <> :without
        GROUP BY status""", {"since": "2000-01-01", "without": "failed"},
        sessions=t["email_sessions"]))

query("s3_parse_json_col", """
    SELECT id, CAST(json_extract_string(interaction_metadata, '$.k') AS INT) AS k
    FROM quality_feedback""")(
    lambda t: logs.parse_json_col(t["quality_feedback"], "interaction_metadata", "k INT", "_m")
    .select("id", "_m.k"))


def appended(t):
    """Feedback written to its log in two appends and read back."""
    path = scratch_dir(t.spark, "log")
    rows = t["quality_feedback"].withColumns({
        "id": F.col("id").cast("string"), "session_id": F.col("session_id").cast("string"),
        "created_at": F.col("created_at").cast("timestamp")})
    for action in (F.col("human_action") == "approved", F.col("human_action") != "approved"):
        logs.append_log(rows.filter(action), path, "quality_feedback")
    return logs.load_tables(t.spark, path, ["quality_feedback"])["quality_feedback"]


query("s4_append_log", """
    SELECT CAST(id AS VARCHAR) AS id, CAST(session_id AS VARCHAR) AS session_id, human_action,
        human_rating, final_quality_score, CAST(created_at AS DATE) AS day FROM quality_feedback""")(
    lambda t: appended(t).select("id", "session_id", "human_action", "human_rating",
                                 "final_quality_score", "day"))
