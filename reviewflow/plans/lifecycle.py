"""Workflow, lifecycle and keyed-update queries."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewflow.operators import workflow as w
from reviewflow.plans.dashboard import NOW
from reviewflow.plans.registry import query
from reviewflow.schemas import DAY, SESSION_CHILDREN
from reviewflow.session import scratch_dir
from reviewflow.sources.keyed import KeyedTable
from reviewflow.sources.logs import drop_days

# Folders of the tables that are changed in place here; on a cluster one for each 100 MB.
BUCKETS = 16


def kept(t, df: DataFrame, key: str) -> KeyedTable:
    return KeyedTable.create(df, scratch_dir(t.spark, "kept") + "/table", key, BUCKETS)


query("l3_start_workflows", """
    SELECT id AS session_id, 'processing' AS workflow_state, 'email_classification' AS current_step,
        '{"available_actions": ["classify", "reject"]}' AS next_actions
    FROM email_sessions WHERE status = 'processing'""")(
    lambda t: w.start_workflows(t["email_sessions"].filter("status = 'processing'")))

_LAST = """(SELECT session_id, action FROM (SELECT session_id, {action} AS action,
        row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS n
    FROM {log} WHERE {action} IN ({allowed})) WHERE n = 1)"""
LAST_FEEDBACK = _LAST.format(action="human_action", log="quality_feedback",
                             allowed="'approved', 'edited', 'rejected'")
LAST_CLICK = _LAST.format(action="split_part(action_value, '_', 1)", log="slack_interactions",
                          allowed="'approve', 'reject', 'rate'")

DUCK_WORKFLOW = f"""
    SELECT ew.session_id, coalesce(action, workflow_state) AS workflow_state,
        CASE action WHEN 'approved' THEN 'ready_to_send' WHEN 'edited' THEN 'pending_revision'
            WHEN 'rejected' THEN 'rejected' ELSE current_step END AS current_step
    FROM email_workflows ew LEFT JOIN {LAST_FEEDBACK} f ON ew.session_id = f.session_id"""
query("l4_workflow_from_feedback", DUCK_WORKFLOW)(
    lambda t: w.workflow_from_feedback(t["email_workflows"], t["quality_feedback"]))

query("l5_workflow_from_clicks", f"""
    SELECT ew.session_id, CASE action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected'
            WHEN 'rate' THEN 'rated' ELSE workflow_state END AS workflow_state,
        CASE action WHEN 'approve' THEN 'creating_gmail_draft'
            WHEN 'reject' THEN 'rejected_by_human' WHEN 'rate' THEN 'awaiting_action'
            ELSE current_step END AS current_step,
        CASE action WHEN 'approve' THEN '{{"available_actions": ["create_draft", "send_email"]}}'
            WHEN 'reject' THEN '{{"available_actions": ["reprocess", "archive"]}}'
            WHEN 'rate' THEN '{{"available_actions": ["approve", "edit", "reject"]}}' END
            AS next_actions
    FROM email_workflows ew LEFT JOIN {LAST_CLICK} c ON ew.session_id = c.session_id""")(
    lambda t: w.workflow_from_clicks(t["email_workflows"], t["slack_interactions"]))

query("l6_status_from_review", f"""
    SELECT es.* REPLACE (coalesce(action, status) AS status)
    FROM email_sessions es LEFT JOIN {LAST_FEEDBACK} f ON es.id = f.session_id""")(
    lambda t: w.status_from_review(t["email_sessions"], t["quality_feedback"]))

query("l7_touch", f"""
    SELECT id, status, CASE WHEN status = 'failed' THEN {NOW} ELSE processing_started_at END
        AS updated_at FROM email_sessions""")(
    lambda t: w.touch(
        t["email_sessions"].select("id", "status", F.col("processing_started_at").alias("updated_at")),
        F.col("status") == "failed",
        t["email_sessions"].select(F.max("processing_started_at")).scalar()))

_LAST_DAYS = """
    SELECT * FROM slack_interactions
    WHERE created_at >= (SELECT max(created_at) FROM slack_interactions) - INTERVAL 10 DAY"""
query("l8_drop_old", _LAST_DAYS)(lambda t: w.drop_old(t["slack_interactions"], None, 10))


def days_dropped(t):
    """The log in day folders, of which those before the edge are deleted."""
    log, path = t["slack_interactions"], scratch_dir(t.spark, "days")
    log.withColumn(DAY, F.to_date("created_at")).hint("rebalance", DAY).write.partitionBy(DAY).parquet(path)
    edge = log.agg(F.max("created_at")).first()[0] - timedelta(days=10)
    drop_days(t.spark, path, edge, "created_at")
    return t.spark.read.parquet(path).drop(DAY)


query("l8_drop_days", _LAST_DAYS)(days_dropped)

query("l9_archive", f"""
    SELECT * REPLACE (CASE WHEN processing_completed_at < {NOW} - INTERVAL 6 MONTH
        AND status IN ('completed', 'approved', 'rejected') THEN 'archived' ELSE status END
        AS status) FROM email_sessions""")(lambda t: w.archive(t["email_sessions"]))


def draft_edits(t):
    """Edited text for the drafts whose document has a quality label."""
    return t["labels"].join(t["documents"], "doc_id").select(
        F.col("doc_id").alias("session_id"),
        F.when(F.col("quality") == 1, F.concat(F.lit("Edited: "), "text"))
        .alias("final_draft_content"),
        F.when(F.col("quality") == 1, F.length("text") + 8).alias("final_draft_length"))


_DRAFTS_EDITED = """
    SELECT dg.session_id, draft_content,
        CASE WHEN l.doc_id IS NULL THEN final_draft_content WHEN quality = 1 THEN 'Edited: ' || text END
            AS final_draft_content,
        CASE WHEN quality = 1 THEN CAST(length(text) + 8 AS INT) END AS final_draft_length
    FROM draft_generations dg LEFT JOIN labels l ON dg.session_id = l.doc_id
    LEFT JOIN documents d ON l.doc_id = d.doc_id"""


def drafts(t):
    return t["draft_generations"].select("session_id", "draft_content", "final_draft_content",
                                         F.lit(None).cast("int").alias("final_draft_length"))


query("s5_apply_updates", _DRAFTS_EDITED)(lambda t: w.apply_updates(
    drafts(t), draft_edits(t), "session_id", ["final_draft_content", "final_draft_length"]))


def drafts_in_place(t):
    table = kept(t, drafts(t), "session_id")
    table.update(draft_edits(t), ["final_draft_content", "final_draft_length"])
    return table.read()


query("s5_update_in_place", _DRAFTS_EDITED)(drafts_in_place)

query("s5_upsert_in_place", """
    SELECT session_id, CASE WHEN session_id % 10 = 0 THEN 'archived' ELSE workflow_state END AS workflow_state,
        CASE WHEN session_id % 10 = 0 THEN 'none' ELSE current_step END AS current_step FROM email_workflows
    UNION ALL SELECT -1 - o_orderkey, 'archived', 'none' FROM orders WHERE o_orderkey % 10 = 0""")(
    lambda t: upserted(t))


def upserted(t):
    table = kept(t, t["email_workflows"], "session_id")
    tenth = t["orders"].filter("o_orderkey % 10 = 0").select(
        F.explode(F.array("o_orderkey", -1 - F.col("o_orderkey"))).alias("session_id"),
        F.lit("archived").alias("workflow_state"), F.lit("none").alias("current_step"))
    table.upsert(tenth)
    return table.read()


def workflows_in_place(t):
    table = kept(t, t["email_workflows"], "session_id")
    feedback = t["quality_feedback"]
    table.rewrite(feedback.select("session_id"), lambda rows: w.workflow_from_feedback(rows, feedback))
    return table.read()


query("l4_workflow_in_place", DUCK_WORKFLOW)(workflows_in_place)

query("s5_mailed_flags", f"""
    SELECT qf.id, qf.session_id, action IS NOT NULL AND action = 'approved' AS gmail_draft_created
    FROM quality_feedback qf LEFT JOIN {LAST_FEEDBACK} f ON qf.session_id = f.session_id""")(
    lambda t: w.apply_updates(
        t["quality_feedback"].select("id", "session_id", F.lit(False).alias("gmail_draft_created")),
        w.last_action(t["quality_feedback"], F.col("human_action"), w.FEEDBACK_STATES)
         .filter(F.col("_last") == "approved")
         .select(F.col("_session").alias("session_id"), F.lit(True).alias("gmail_draft_created")),
        "session_id", ["gmail_draft_created"]))


def _remaining(t):
    gone = t["email_sessions"].filter("status = 'failed'").select("id")
    return reduce(DataFrame.unionByName, [
        df.groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"))
          .select(F.lit(name).alias("table_name"), "session_id", "rows")
        for name, df in w.cascade_delete(t, gone).items()])


query("s8_cascade_delete", " UNION ALL ".join(f"""
    SELECT '{name}' AS table_name, session_id, count(*) AS rows FROM {name}
    WHERE session_id NOT IN (SELECT id FROM email_sessions WHERE status = 'failed')
    GROUP BY session_id""" for name in SESSION_CHILDREN))(_remaining)
