"""Session and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewflow.operators import dashboard as d
from reviewflow.operators import review as r
from reviewflow.operators import sessions as s
from reviewflow.plans.dashboard import NOW
from reviewflow.plans.lifecycle import kept
from reviewflow.plans.registry import query, rounded
from reviewflow.sources.driver_tables import _LABEL

CLICK_NOW = "(SELECT max(created_at) FROM slack_interactions)"
FEEDBACK_NOW = "(SELECT max(created_at) FROM quality_feedback)"

query("j1_session_summary", """
    SELECT es.id, sender_email, sender_name, subject, classification, status,
        processing_started_at, processing_completed_at, total_duration_ms, workflow_state,
        current_step, human_action, human_rating, client_matched, client_name,
        template_adherence_score
    FROM email_sessions es LEFT JOIN email_workflows ew ON es.id = ew.session_id
    LEFT JOIN quality_feedback qf ON es.id = qf.session_id
    LEFT JOIN document_extractions de ON es.id = de.session_id
    LEFT JOIN draft_generations dg ON es.id = dg.session_id""")(lambda t: s.session_summary(t))

query("j2_session_detail", """
    SELECT es.*, predicted_label, confidence_score, client_matched, documents_found, draft_length,
        context_used, draft_content, final_draft_content, human_action, human_rating,
        final_quality_score
    FROM email_sessions es LEFT JOIN classification_results cr ON es.id = cr.session_id
    LEFT JOIN document_extractions de ON es.id = de.session_id
    LEFT JOIN draft_generations dg ON es.id = dg.session_id
    LEFT JOIN quality_feedback qf ON es.id = qf.session_id""")(lambda t: s.session_detail(t))

_RECENT = """
    SELECT es.id, sender_email, sender_name, subject, classification, processing_started_at,
        total_duration_ms, status, confidence_score, client_matched, client_name,
        template_adherence_score, context_used
    FROM email_sessions es LEFT JOIN classification_results cr ON es.id = cr.session_id
    LEFT JOIN document_extractions de ON es.id = de.session_id
    LEFT JOIN draft_generations dg ON es.id = dg.session_id
    ORDER BY processing_started_at DESC NULLS FIRST, es.id, confidence_score NULLS LAST,
        client_matched NULLS LAST, client_name NULLS LAST, template_adherence_score NULLS LAST,
        context_used NULLS LAST
    LIMIT 50"""
query("j3_recent_sessions", _RECENT)(lambda t: s.recent_sessions(t))

query("f9_sessions", f"""
    SELECT id, processing_started_at, coalesce(sender_email, '-') AS sender,
        CASE WHEN subject <> '' THEN substr(subject, 1, 30) || '...' ELSE '-' END AS subject,
        coalesce(classification, '-') AS label,
        CASE WHEN total_duration_ms <> 0
            THEN CAST(floor(total_duration_ms / 1000 + 0.5E0) AS BIGINT) || 's'
            ELSE '-' END AS duration,
        CASE WHEN status = 'completed' THEN 'success' ELSE 'danger' END AS badge,
        (CASE WHEN client_matched THEN '✓ ' ELSE '✗ ' END) || coalesce(client_name, '') AS client,
        CASE WHEN template_adherence_score <> 0
            THEN CAST(floor(template_adherence_score * 100 + 0.5E0) AS BIGINT) || '%'
            ELSE '-' END AS quality
    FROM ({_RECENT})""")(lambda t: d.dashboard_cols(s.recent_sessions(t), "sessions"))

query("j4_review_card", """
    SELECT es.id, sender_email, sender_name, subject, classification, draft_content,
        final_draft_content, workflow_state, current_step,
        coalesce(nullif(final_draft_content, ''), nullif(draft_content, ''),
            'No draft content available') AS draft_text
    FROM email_sessions es LEFT JOIN draft_generations dg ON es.id = dg.session_id
    LEFT JOIN email_workflows ew ON es.id = ew.session_id""")(lambda t: s.review_card(t))

query("j5_pending_sessions", """
    SELECT es.id, sender_email, subject, processing_completed_at, workflow_state, current_step
    FROM email_sessions es JOIN email_workflows ew ON es.id = ew.session_id
    LEFT JOIN quality_feedback qf ON es.id = qf.session_id
    WHERE workflow_state = 'pending_review' AND qf.id IS NULL""")(lambda t: s.pending_sessions(t))

# Checks below work from the driver's own tables, so they test the derivation of the log as well.
ORDERS_NOW = "(SELECT max(o_orderdate) FROM orders)"
EVENTS_NOW = "(SELECT max(ts) FROM events)"
# Orders that are over, with the time they ended at.
OVER = """
    SELECT o_orderkey, o_custkey, o_orderpriority,
        o_orderdate + to_seconds(CAST(floor(o_totalprice / 1000) AS BIGINT)) AS over_at
    FROM orders WHERE o_orderstatus IN ('F', 'P')"""


def per_cent(part: str, whole: str) -> str:
    """Per cent with two decimals, rounded half up in whole numbers."""
    return f"(({part}) * 20000 + ({whole})) // (2 * ({whole})) / 100.0E0"


query("j6_overdue_sessions", f"""
    SELECT o_orderkey AS id, 'user' || o_custkey || '@example.com' AS sender_email,
        'Re: ' || o_orderpriority AS subject, over_at AS processing_completed_at,
        round(date_diff('second', over_at, {ORDERS_NOW}) / 3600.0E0, 6) AS hours_pending
    FROM ({OVER}) WHERE o_orderkey % 5 = 0 AND over_at + INTERVAL 1 DAY < {ORDERS_NOW}""")(
    lambda t: rounded(s.overdue_sessions(t), "hours_pending"))

_CLICKED = f"""
    WITH clicks AS (
        SELECT CASE event_type WHEN 'view' THEN 'selection' ELSE 'button_click' END AS interaction_type,
            CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'edit'
                WHEN 'view' THEN 'rate_' || (event_id % 5 + 1) ELSE 'feedback' END AS action_value,
            event_type, user_id, event_id // 2 AS session, floor(value * 10) AS ms
        FROM events WHERE ts >= {EVENTS_NOW} - INTERVAL 30 DAY)"""
query("a14_interaction_stats", _CLICKED + """
    SELECT interaction_type, action_value, count(*) AS interaction_count,
        count(DISTINCT user_id) AS unique_users, coalesce(avg(ms), 0) AS avg_response_time
    FROM clicks GROUP BY interaction_type, action_value""")(lambda t: r.interaction_stats(t))

_ENGAGED = _CLICKED + """
    SELECT 'user' || user_id AS user_name, count(*) AS total_interactions,
        count(DISTINCT session) AS sessions_reviewed,
        avg(ms) FILTER (event_type <> 'view') AS avg_response_time,
        count(*) FILTER (event_type = 'view') AS ratings_given,
        count(*) FILTER (event_type = 'purchase') AS approvals,
        count(*) FILTER (event_type = 'error') AS rejections
    FROM clicks GROUP BY user_id"""
query("a15_reviewer_engagement", _ENGAGED)(lambda t: r.reviewer_engagement(t))


def near(counted, exact, keys, column):
    """Rows of ``exact``, each with whether the count from sketches is within two per cent, or one, of it."""
    other = counted.select(*keys, F.col(column).alias("_other"))
    off = F.abs(F.col("_other") - F.col(column))
    return exact.join(other, keys, "left").select(
        *keys, column, (off <= F.greatest(F.lit(1), 0.02 * F.col(column))).alias("close"))


def sketched(t):
    return r.interaction_days(t["slack_interactions"])


# Sketches of distinct counts have no counterpart in the checker: the exact count, and that they are close to it.
query("a14_sketched_users", _CLICKED + """
    SELECT interaction_type, action_value, count(DISTINCT user_id) AS unique_users, true AS close
    FROM clicks GROUP BY interaction_type, action_value""")(
    lambda t: near(r.interaction_stats_of_days(sketched(t)), r.interaction_stats(t),
                   ["interaction_type", "action_value"], "unique_users"))
query("a15_sketched_sessions", _CLICKED + """
    SELECT 'user' || user_id AS user_name, count(DISTINCT session) AS sessions_reviewed, true AS close
    FROM clicks GROUP BY user_id""")(
    lambda t: near(r.engagement_of_days(r.engagement_days(t["slack_interactions"])), r.reviewer_engagement(t),
                   ["user_name"], "sessions_reviewed"))

# Feedback reaches the lower session ids, whose start dates are spread over all years.
APPROVAL_DAYS = 3650

for _days, _name in ((30, "a16_approval_rates"), (APPROVAL_DAYS, "a16_approval_rates_all")):
    query(_name, f"""
        WITH voted AS (SELECT event_id // 2 AS o_orderkey, event_type FROM events),
        seen AS (SELECT {_LABEL} AS classification, coalesce(event_type, '') AS vote
            FROM ({OVER}) LEFT JOIN voted USING (o_orderkey)
            WHERE over_at + INTERVAL {_days} DAY >= {ORDERS_NOW}),
        tally AS (SELECT classification, vote, count(*) AS n FROM seen GROUP BY ALL),
        wide AS (SELECT classification, CAST(sum(n) AS BIGINT) AS total_sessions,
            CAST(sum(if(vote = 'purchase', n, 0)) AS BIGINT) AS approved,
            CAST(sum(if(vote = 'error', n, 0)) AS BIGINT) AS rejected,
            CAST(sum(if(vote = 'click', n, 0)) AS BIGINT) AS edited FROM tally GROUP BY 1)
        SELECT *, {per_cent("approved", "total_sessions")} AS approval_rate FROM wide""")(lambda t, days=_days: r.approval_rates(t, days))

query("w1_rating_dist", f"""
    WITH given AS (SELECT CAST(event_id % 5 + 1 AS INT) AS human_rating FROM events
        WHERE event_type IN ('purchase', 'error', 'view')
            AND ts + INTERVAL 30 DAY >= {EVENTS_NOW}),
    whole AS (SELECT count(*) AS n FROM given)
    SELECT human_rating, count(*) AS rating_count, {per_cent("count(*)", "any_value(n)")} AS percentage
    FROM given, whole GROUP BY human_rating""")(lambda t: r.rating_dist(t))

query("a17_workflow_summary", f"""
    SELECT ['pending_review', 'approved', 'rejected', 'edited', 'draft_created'][o_orderkey % 5 + 1]
            AS workflow_state, count(*) AS session_count,
        round(avg(date_diff('second', over_at, {ORDERS_NOW})) / 3600, 6) AS avg_hours_in_state
    FROM ({OVER}) WHERE over_at + INTERVAL 7 DAY >= {ORDERS_NOW} GROUP BY o_orderkey % 5""")(
    lambda t: rounded(r.workflow_summary(t), "avg_hours_in_state"))

query("a18_feedback_daily", """
    SELECT CAST(ts AS DATE) AS feedback_date, count(*) AS total_feedback,
        avg(event_id % 5 + 1) FILTER (event_type IN ('purchase', 'error', 'view')) AS avg_rating,
        count(*) FILTER (event_type = 'purchase') AS approved_count,
        count(*) FILTER (event_type = 'click') AS edited_count,
        count(*) FILTER (event_type = 'error') AS rejected_count,
        round(avg(final_quality_score), 6) AS avg_quality_score
    FROM events JOIN (SELECT id, final_quality_score FROM quality_feedback) ON id = event_id GROUP BY 1""")(
    lambda t: rounded(r.feedback_daily(t), "avg_quality_score"))

query("w4_feedback_history", """
    SELECT session_id, human_action, human_rating, slack_user_name, created_at
    FROM quality_feedback""")(lambda t: r.feedback_history(t))

query("w4_latest_feedback", """
    SELECT session_id, human_action, human_rating, created_at
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC)
            AS n FROM quality_feedback) WHERE n = 1""")(lambda t: r.latest_feedback(t))

query("w5_interaction_history", """
    SELECT session_id, interaction_type, action_value, user_name, created_at, payload
    FROM slack_interactions""")(lambda t: r.interaction_history(t))

# Lines of an order as marks of three nodes that are started again and again. A tenth of the starts and a
# fifth of the ends are missing.
MARKS_SQL = """
    SELECT l_orderkey AS session_id, 'node_' || l_linenumber % 3 AS node_name,
        CAST(l_orderkey % 2 AS BIGINT) AS run, 'start' AS mark, l_shipdate AS moment,
        CAST(NULL AS BOOLEAN) AS success
    FROM lineitem WHERE l_partkey % 10 <> 0
    UNION ALL
    SELECT l_orderkey, 'node_' || l_linenumber % 3, CAST(l_orderkey % 2 AS BIGINT), 'end',
        l_shipdate + to_seconds(CAST(floor(l_quantity * 40000) AS BIGINT)), l_returnflag <> 'R'
    FROM lineitem WHERE l_partkey % 5 <> 1"""
DURATIONS_SQL = f"""
    SELECT session_id, node_name, run, since AS started_at, moment AS completed_at, success,
        CAST(least(epoch_ms(moment) - epoch_ms(since), 2147483647) AS INT) AS duration_ms
    FROM (SELECT *, lag(mark) OVER run_order AS before, lag(moment) OVER run_order AS since
          FROM ({MARKS_SQL}) WINDOW run_order AS (PARTITION BY session_id, node_name, run
              ORDER BY moment, mark DESC, success))
    WHERE mark = 'end' AND before = 'start'"""


def node_marks(t):
    """Start and end marks of each node run, as rows."""
    line = t["lineitem"].select(
        F.col("l_orderkey").alias("session_id"),
        F.concat(F.lit("node_"), F.col("l_linenumber") % 3).alias("node_name"),
        (F.col("l_orderkey") % 2).alias("run"), (F.col("l_returnflag") != "R").alias("success"),
        "l_shipdate", "l_partkey",
        F.expr("l_shipdate + make_interval(0,0,0,0,0,0, floor(l_quantity * 40000))").alias("_end"))
    starts = line.filter("l_partkey % 10 <> 0").select(
        "session_id", "node_name", "run", F.lit("start").alias("mark"), F.col("l_shipdate").alias("at"),
        F.lit(None).cast("boolean").alias("success"))
    ends = line.filter("l_partkey % 5 <> 1").select(
        "session_id", "node_name", "run", F.lit("end").alias("mark"), F.col("_end").alias("at"), "success")
    return starts.unionByName(ends)


query("f6_node_durations", DURATIONS_SQL)(lambda t: s.node_durations(node_marks(t)))


CLOSED_SQL = f"""
    SELECT es.* REPLACE (
        CASE WHEN cr.session_id IS NULL THEN processing_completed_at ELSE {NOW} END
            AS processing_completed_at,
        CASE WHEN cr.session_id IS NULL THEN total_duration_ms
            ELSE CAST(least(epoch_ms({NOW}) - epoch_ms(processing_started_at), 2147483647) AS INT)
            END AS total_duration_ms,
        CASE WHEN cr.session_id IS NULL THEN status WHEN is_correct THEN 'completed'
            ELSE 'failed' END AS status,
        CASE WHEN cr.session_id IS NULL THEN error_message WHEN NOT is_correct THEN 'wrong label'
            END AS error_message,
        CASE WHEN cr.session_id IS NULL THEN classification ELSE predicted_label END
            AS classification)
    FROM email_sessions es LEFT JOIN classification_results cr
        ON es.id = cr.session_id AND es.status = 'processing'"""
query("f7_close_sessions", CLOSED_SQL)(lambda t: s.close_sessions(t["email_sessions"], _results(t), None))


def closed_in_place(t):
    """Sessions kept in buckets; only the buckets of sessions with a result are read and written."""
    table = kept(t, t["email_sessions"], "id")
    now = F.lit(t["email_sessions"].agg(F.max(s.STARTED)).first()[0]).cast("timestamp_ntz")
    results = _results(t)
    table.rewrite(results.select("session_id"), lambda rows: s.close_sessions(rows, results, now))
    return table.read()


query("f7_close_in_place", CLOSED_SQL)(closed_in_place)



def _results(t):
    """A result for each session still open that got a label; a wrong label is an error."""
    open_ids = t["email_sessions"].filter("status = 'processing'").select("id")
    return t["classification_results"].join(open_ids, F.col("session_id") == F.col("id")) \
        .select("session_id", F.col("predicted_label").alias("label"),
                F.when(~F.col("is_correct"), "wrong label").alias("error"))
