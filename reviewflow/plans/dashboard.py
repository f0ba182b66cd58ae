"""Dashboard queries."""

from __future__ import annotations

from reviewflow.operators import dashboard as d
from reviewflow.operators import sessions as s
from reviewflow.plans.registry import query, rounded

NOW = "(SELECT max(processing_started_at) FROM email_sessions)"


def started(days: int, alias: str = "") -> str:
    return f"{alias}processing_started_at > {NOW} - INTERVAL {days} DAY"


query("a1_overview", f"""
    SELECT total_sessions, round_even(done / greatest(total_sessions, 1) * 100, 1) AS success_rate,
        round_even(coalesce(ms, 0) / 1000, 2) AS avg_processing_time, 'Last 7 days' AS time_period
    FROM (SELECT count(*) AS total_sessions, count(*) FILTER (status = 'completed') AS done,
            avg(total_duration_ms) FILTER (status = 'completed') AS ms
          FROM email_sessions WHERE {started(7)})""")(lambda t: d.overview(t))

query("a2_label_counts", f"""
    SELECT classification, count(*) AS count FROM email_sessions
    WHERE {started(7)} AND classification IS NOT NULL GROUP BY classification""")(
    lambda t: d.label_counts(t))

query("a3_classification_dist", f"""
    SELECT predicted_label, count, round(avg_confidence, 6) AS avg_confidence,
        CAST(sum(count) OVER () AS BIGINT) AS total_classifications
    FROM (SELECT predicted_label, count(*) AS count, avg(confidence_score) AS avg_confidence
          FROM classification_results cr JOIN email_sessions es ON cr.session_id = es.id
          WHERE {started(30, 'es.')} GROUP BY predicted_label)""")(
    lambda t: rounded(d.classification_dist(t), "avg_confidence"))

query("a4_classification_trend", f"""
    SELECT CAST(es.processing_started_at AS DATE) AS date, predicted_label, count(*) AS count
    FROM classification_results cr JOIN email_sessions es ON cr.session_id = es.id
    WHERE {started(30, 'es.')} GROUP BY ALL""")(lambda t: d.classification_trend(t))

query("a5_timeline", f"""
    SELECT processing_started_at, total_duration_ms, status, classification, sender_email
    FROM email_sessions WHERE processing_started_at > {NOW} - INTERVAL 24 HOUR""")(
    lambda t: d.timeline(t))

query("a5_timeline_summary", f"""
    SELECT count(*) AS total_processed, round_even(avg(total_duration_ms) / 1000, 2) AS avg_time,
        count(*) FILTER (status = 'completed') AS success_count
    FROM email_sessions WHERE processing_started_at > {NOW} - INTERVAL 72 HOUR
    HAVING count(*) > 0""")(lambda t: d.timeline_summary(t, hours=72))

# Checks of the figures over facts work from the driver's own tables.
def ordered(days: int) -> str:
    """Keys and days of the orders of the last days."""
    return f"""(SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS date FROM orders
        WHERE o_orderdate + INTERVAL {days} DAY > (SELECT max(o_orderdate) FROM orders))"""


def share(part: str, whole: str) -> str:
    """Per cent with one decimal, half to even; 0 of an empty whole."""
    return f"round_even(100.0E0 * ({part}) / greatest({whole}, 1), 1)"


_EXTRACTION = f"""
    SELECT count(*) AS total_attempts, count(*) FILTER (l_discount >= 0.05) AS client_matches,
        count(*) FILTER (l_linestatus = 'F') AS successful_extractions,
        avg(CAST(l_quantity AS INT)) AS avg_docs_found,
        {share("count(*) FILTER (l_linestatus = 'F')", "count(*)")} AS success_rate
    FROM lineitem SEMI JOIN {ordered(30)} ON l_orderkey = k"""
query("a6_extraction_stats", _EXTRACTION)(lambda t: d.extraction_stats(t))

query("a7_match_trend", f"""
    SELECT date, count(*) AS total_attempts, count(*) FILTER (l_discount >= 0.05) AS matches
    FROM lineitem JOIN {ordered(30)} ON l_orderkey = k GROUP BY date""")(lambda t: d.match_trend(t))

# Drafts follow the document ids, which end early; a long period reaches them.
DRAFT_DAYS = 3650

_SIZED = f"""(SELECT n_chars, lang <> 'en' AS used, n_chars // 2 AS around, date
    FROM documents JOIN {ordered(DRAFT_DAYS)} ON doc_id = k)"""
# The bands of the template score, by length.
_GRADE = """CASE WHEN n_chars < 100 THEN 0.2E0 WHEN n_chars < 200 THEN 0.5E0 WHEN n_chars <= 500 THEN 1.0E0
    WHEN n_chars <= 800 THEN 0.8E0 ELSE 0.6E0 END"""
query("a8_draft_stats", f"""
    SELECT count(*) AS total_drafts, avg(n_chars) AS avg_length,
        round(avg({_GRADE}), 6) AS avg_template_score, count(*) FILTER (used) AS context_usage_count,
        avg(if(used, around, NULL)) AS avg_context_length,
        {share("count(*) FILTER (used)", "count(*)")} AS context_usage_rate FROM {_SIZED}""")(
    lambda t: rounded(d.draft_stats(t, DRAFT_DAYS), "avg_template_score"))

query("a9_draft_trend", f"""
    SELECT date, round(avg({_GRADE}), 6) AS avg_quality, count(*) AS draft_count
    FROM {_SIZED} GROUP BY date""")(lambda t: rounded(d.draft_trend(t, DRAFT_DAYS), "avg_quality"))

query("a10_length_hist", f"""
    SELECT name AS length_category, count(*) AS count
    FROM {_SIZED} JOIN (VALUES ('Very Short', 0, 99), ('Short', 100, 249), ('Medium', 250, 499),
        ('Long', 500, 999), ('Very Long', 1000, 2000000000)) AS class(name, low, high)
        ON n_chars BETWEEN low AND high GROUP BY name""")(lambda t: d.length_hist(t, DRAFT_DAYS))

_RUNS = f"""(SELECT 'node_' || l_linenumber AS node_name, floor(l_extendedprice) AS ms,
        l_returnflag IN ('A', 'N') AS ok, date FROM lineitem JOIN {ordered(7)} ON l_orderkey = k)"""
_NODES = f"""
    SELECT node_name, count(*) AS executions, avg(ms) AS avg_duration, count(*) FILTER (ok) AS successful,
        count(*) FILTER (NOT ok) AS failed FROM {_RUNS} GROUP BY node_name"""
query("a11_node_stats", _NODES)(lambda t: d.node_stats(t))

query("a12_node_trend", f"SELECT date, node_name, avg(ms) AS avg_duration FROM {_RUNS} GROUP BY ALL")(
    lambda t: d.node_trend(t))

query("a13_system_health", f"""
    SELECT round_even(count(*) FILTER (recent AND status = 'failed')
            / greatest(count(*) FILTER (recent), 1) * 100, 1) AS error_rate,
        count(*) AS total_sessions, count(*) FILTER (day) AS sessions_24h
    FROM (SELECT status, processing_started_at > {NOW} - INTERVAL 1 HOUR AS recent,
            processing_started_at > {NOW} - INTERVAL 24 HOUR AS day FROM email_sessions)""")(
    lambda t: d.system_health(t))

query("w6_top_clients", """
    SELECT client_name, count(*) AS match_count FROM document_extractions
    WHERE client_matched AND client_name IS NOT NULL GROUP BY client_name
    ORDER BY match_count DESC, client_name LIMIT 10""")(lambda t: d.top_clients(t))

query("j9_in_period", f"""
    SELECT ne.*, CAST(es.processing_started_at AS DATE) AS date
    FROM node_executions ne JOIN email_sessions es ON ne.session_id = es.id
    WHERE {started(30, 'es.')}""")(
    lambda t: s.in_period(t["node_executions"], t["email_sessions"]))

query("f5_within_months", f"""
    SELECT id, processing_started_at, status FROM email_sessions
    WHERE processing_started_at >= {NOW} - INTERVAL 6 MONTH""")(
    lambda t: d.within(t["email_sessions"], d.STARTED, None, 6, "months", closed=True)
    .select("id", d.STARTED, "status"))

query("f9_documents", f"""
    SELECT *, CAST(floor(client_matches / greatest(total_attempts, 1) * 100 + 0.5E0) AS BIGINT)
            AS client_match_rate,
        CAST(floor(successful_extractions / greatest(total_attempts, 1) * 100 + 0.5E0) AS BIGINT)
            AS extraction_rate
    FROM ({_EXTRACTION})""")(lambda t: d.dashboard_cols(d.extraction_stats(t), "documents"))

query("f9_nodes", f"""
    SELECT node_name, executions, avg_ms, success_rate,
        CASE WHEN success_rate > 95 THEN 'good' WHEN success_rate > 85 THEN 'warn'
            ELSE 'bad' END AS band
    FROM (SELECT node_name, executions, CAST(floor(avg_duration + 0.5E0) AS BIGINT) AS avg_ms,
            CAST(floor(successful / executions * 100 + 0.5E0) AS BIGINT) AS success_rate
          FROM ({_NODES}))""")(lambda t: d.dashboard_cols(d.node_stats(t), "nodes"))
