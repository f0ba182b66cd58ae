"""Constraint, report and record queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewflow import schemas as sm
from reviewflow.operators import crm
from reviewflow.operators import quality as q
from reviewflow.operators import report as r
from reviewflow.plans.registry import query, rounded
from reviewflow.sources.driver_tables import COLUMNS, LOG_TABLES

# Columns of the derived tables, which hold a part of each schema.
_HELD = {
    "email_sessions": {"id", "email_hash", "sender_email", "sender_name", "classification",
                       "status", "total_duration_ms"},
    "node_executions": {"node_name", "duration_ms"},
    "classification_results": {"predicted_label", "human_verified_label", "confidence_score"},
    "document_extractions": {"client_name", "documents_found", "extraction_duration_ms"},
    "draft_generations": {"draft_length", "context_length", "template_adherence_score"},
    "quality_feedback": {"human_action", "human_rating", "edit_distance", "slack_user_name",
                         "final_quality_score"},
    "slack_interactions": {"interaction_type", "action_value", "user_name"},
    "email_workflows": {"workflow_state", "current_step"},
    "prompt_templates": {"prompt_name", "category"},
    "prompt_versions": {"version", "content", "performance_score", "usage_count"},
    "prompt_usage": {"node_name", "execution_time_ms", "output_quality_score"},
    "system_metrics": {"metric_name", "metric_value"},
    **{name: set(COLUMNS[name]) for name in ("audit_logs", "ab_test_configs", "user_sessions")},
}


def _count(table: str, rule: str, bad: str) -> str:
    return (f"SELECT '{table}' AS table_name, '{rule}' AS rule, "
            f"count(*) FILTER ({bad}) AS violations FROM {table}")


def _range_sql() -> str:
    parts = []
    for table, columns in sm.RANGES.items():
        for c, (low, high) in columns.items():
            if c in _HELD.get(table, ()):
                bad = [f"{c} < {low}"] if low is not None else []
                bad += [f"{c} > {high}"] if high is not None else []
                parts.append(_count(table, f"{c} in range", " OR ".join(bad)))
    return " UNION ALL ".join(parts)


def _value_sql() -> str:
    parts = []
    for table, held in _HELD.items():
        for c in sm.REQUIRED_COLUMNS.get(table, ()):
            if c in held:
                parts.append(_count(table, f"{c} present", f"{c} IS NULL"))
        for c, limit in sm.MAX_LENGTHS.get(table, {}).items():
            if c in held:
                parts.append(_count(table, f"{c} length", f"length({c}) > {limit}"))
        for (name, c), values in sm.ALLOWED_VALUES.items():
            if name == table and c in held:
                listed = ", ".join(f"'{v}'" for v in values)
                parts.append(_count(table, f"{c} allowed", f"{c} NOT IN ({listed})"))
    return " UNION ALL ".join(parts)


class _Broken(dict):
    """The log tables with faults that follow from the data, so that the rules find some."""

    def __init__(self, t):
        super().__init__({name: t[name] for name in LOG_TABLES})
        self["quality_feedback"] = t["quality_feedback"].withColumn(
            "human_rating", F.col("human_rating") + 1)
        self["email_sessions"] = t["email_sessions"].withColumn("status", F.when(
            F.col("status") == "failed", "broken").otherwise(F.col("status")))


_BROKEN = {
    "FROM quality_feedback": "FROM (SELECT * REPLACE (human_rating + 1 AS human_rating) "
                             "FROM quality_feedback)",
    "FROM email_sessions": "FROM (SELECT * REPLACE (CASE WHEN status = 'failed' THEN 'broken' "
                           "ELSE status END AS status) FROM email_sessions)",
}


def _broken(sql: str) -> str:
    for plain, changed in _BROKEN.items():
        sql = sql.replace(plain, changed)
    return sql


query("q1_check_ranges", _range_sql())(lambda t: q.check_ranges(t))
query("q1_check_ranges_faults", _broken(_range_sql()))(lambda t: q.check_ranges(_Broken(t)))
query("q2_check_values", _value_sql())(lambda t: q.check_values(t))
query("q2_check_values_faults", _broken(_value_sql()))(lambda t: q.check_values(_Broken(t)))

query("q1_bad_rows", """
    SELECT id, human_rating + 1 AS human_rating, 'human_rating in range' AS broken_rules
    FROM quality_feedback WHERE human_rating + 1 NOT BETWEEN 1 AND 5""")(
    lambda t: q.bad_rows(_Broken(t)["quality_feedback"],
                         q.range_rules(t["quality_feedback"], "quality_feedback"))
    .select("id", "human_rating", F.array_join("broken_rules", ",").alias("broken_rules")))

query("q3_check_unique", """
    SELECT 'email_sessions' AS table_name, 'email_hash' AS rule, count(*) AS violations
    FROM (SELECT 1 FROM email_sessions GROUP BY email_hash HAVING count(*) > 1) UNION ALL
    SELECT 'prompt_templates', 'prompt_name', count(*)
    FROM (SELECT 1 FROM prompt_templates GROUP BY prompt_name HAVING count(*) > 1) UNION ALL
    SELECT 'prompt_versions', 'prompt_name, version', count(*)
    FROM (SELECT 1 FROM prompt_versions GROUP BY prompt_name, version HAVING count(*) > 1) UNION ALL
    SELECT 'ab_test_configs', 'test_name', count(*)
    FROM (SELECT 1 FROM ab_test_configs GROUP BY test_name HAVING count(*) > 1) UNION ALL
    SELECT 'user_sessions', 'session_token', count(*)
    FROM (SELECT 1 FROM user_sessions GROUP BY session_token HAVING count(*) > 1)""")(
    lambda t: q.check_unique(t))
query("q3_duplicates", """
    SELECT text, sender_email, copies FROM (SELECT body AS text, sender_email, count(*) AS copies
        FROM mails GROUP BY ALL HAVING count(*) > 1)""")(
    lambda t: q.duplicates(t["mails"].withColumnRenamed("body", "text"), ("text", "sender_email")))

_ORPHANS = " UNION ALL ".join(f"""
    SELECT '{child}' AS table_name, '{column} -> {parent}' AS rule, count(*) AS violations
    FROM {child} WHERE {column} NOT IN (SELECT {key} FROM {parent})"""
    for child, column, parent, key in sm.REFERENCES
    if child in LOG_TABLES and (child, column) != ("prompt_usage", "prompt_name"))
query("q4_check_orphans", _ORPHANS)(lambda t: q.check_orphans(t))
query("q4_orphans", """
    SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")(
    lambda t: q.orphans(t["documents"], "doc_id", t["labels"], "doc_id").select("doc_id", "text"))

query("q5_check_score", f"""
    SELECT CAST(sum(ok) AS BIGINT) AS passed, count(*) AS checks, avg(ok) * 100 AS score,
        avg(ok) * 100 >= 80 AS sufficient
    FROM (SELECT CAST(violations = 0 AS INT) AS ok
          FROM ({_broken(_range_sql())} UNION ALL {_broken(_value_sql())}))""")(
    lambda t: q.check_score(q.check_ranges(_Broken(t)).unionByName(q.check_values(_Broken(t)))))


def results(t):
    """Run results: each session with its label, time and features."""
    s = t["email_sessions"].withColumnRenamed("id", "session")
    return s.select(
        F.col("error_message").alias("error"), "classification",
        F.when(F.col("classification") == "No Guests", "Hard Rejection").otherwise("")
        .alias("rejection_type"),
        (F.col("total_duration_ms") / 1000).alias("processing_time"),
        (F.col("status") == "completed").alias("draft_generated"),
        F.col("classification").isNotNull().alias("notice_sent"),
        F.col("sender_email").contains("9").alias("folder_found"))


query("a20_run_report", """
    SELECT count(*) AS total_tests, count(*) FILTER (error_message IS NULL) AS successful,
        count(*) FILTER (error_message IS NOT NULL) AS failed,
        round_even(count(*) FILTER (error_message IS NULL) / greatest(count(*), 1) * 100, 1)
            AS success_rate,
        round(avg(total_duration_ms / 1000) FILTER (error_message IS NULL), 6) AS avg_time,
        min(total_duration_ms / 1000) FILTER (error_message IS NULL) AS min_time,
        max(total_duration_ms / 1000) FILTER (error_message IS NULL) AS max_time,
        count(*) FILTER (status = 'completed') AS drafts_generated,
        count(*) FILTER (classification IS NOT NULL) AS notices_sent,
        count(*) FILTER (contains(sender_email, '9')) AS folders_found
    FROM email_sessions""")(lambda t: rounded(r.run_report(results(t)), "avg_time"))
query("a20_label_counts", """
    SELECT coalesce(classification, 'Unknown') AS classification, count(*) AS count
    FROM email_sessions WHERE error_message IS NULL GROUP BY 1""")(
    lambda t: r.report_counts(results(t), "classification", "Unknown"))
query("a20_rejection_counts", """
    SELECT 'Hard Rejection' AS rejection_type, count(*) AS count FROM email_sessions
    WHERE error_message IS NULL AND classification = 'No Guests'""")(
    lambda t: r.report_counts(results(t), "rejection_type"))

query("i1_accuracy", """
    SELECT predicted_label, count(*) AS verified, count(*) FILTER (is_correct) AS correct,
        round_even(count(*) FILTER (is_correct) / count(*) * 100, 1) AS accuracy
    FROM classification_results WHERE human_verified_label IS NOT NULL GROUP BY 1""")(
    lambda t: r.classification_accuracy(t["classification_results"]))
query("i1_confusion", """
    SELECT predicted_label, human_verified_label, count(*) AS count
    FROM classification_results WHERE human_verified_label IS NOT NULL GROUP BY ALL""")(
    lambda t: r.confusion(t["classification_results"]))
query("i4_metric_rollup", """
    SELECT metric_name, date_trunc('hour', timestamp) AS hour, count(*) AS samples,
        round(avg(metric_value), 9) AS avg_value, min(metric_value) AS min_value,
        max(metric_value) AS max_value
    FROM system_metrics GROUP BY ALL""")(
    lambda t: rounded(r.metric_rollup(t["system_metrics"]), "avg_value", digits=9))
query("i5_time_to_review", """
    SELECT session_id, drafted_at, reviewed_at,
        round(epoch(reviewed_at - drafted_at) / 3600, 6) AS hours_to_review
    FROM (SELECT message_id, min(received_at) AS drafted_at FROM mails GROUP BY 1)
    JOIN (SELECT session_id, min(created_at) AS reviewed_at FROM quality_feedback GROUP BY 1)
        ON message_id = session_id""")(
    lambda t: rounded(r.time_to_review(t["mails"].select(
        F.col("message_id").alias("session_id"), F.col("received_at").alias("created_at")),
        t["quality_feedback"]), "hours_to_review"))

query("w8_page", """
    SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 100 OFFSET 200""")(
    lambda t: crm.page(t["customer"], ["c_acctbal", "c_custkey"], 3, 100)
    .select("c_custkey", "c_name"))

# A deep page by a text of which each value has a third of the rows.
_LINE = ["l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
query("w8_deep_page", f"""
    SELECT {", ".join(_LINE)} FROM lineitem ORDER BY ALL LIMIT 500 OFFSET 45000""")(
    lambda t: crm.page(t["lineitem"].select(*_LINE), _LINE, 91, 500))


def crm_records(t):
    """A reply per customer: expired and current entries, options, empty lists."""
    entry = lambda key, value, until: F.concat(
        F.lit('{"active_until":'), F.coalesce(until, F.lit("null")), F.lit(f',"{key}":'), value,
        F.lit("}"))
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    none = F.lit(None).cast("string")
    values = F.concat(
        F.lit('{"name":['), entry("value", F.lit('"old"'), F.lit('"2020-01-01"')), F.lit(","),
        entry("value", text(F.col("c_name")), none), F.lit('],"segment":['),
        entry("option", F.concat(F.lit('{"title":'), text(F.col("c_mktsegment")), F.lit("}")), none),
        F.lit('],"empty":[],"gone":['), entry("value", F.lit("1"), F.lit('"2021-01-01"')),
        F.lit('],"undated":[{"value":"x"}]}'))
    record = F.concat(F.lit('[{"id":{"record_id":"r'), "c_custkey", F.lit('"},"values":'), values,
                      F.lit("}]"))
    reply = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit('{"data":'), record, F.lit("}"))) \
        .otherwise(F.concat(F.lit('{"data":{"records":'), record, F.lit("}}")))
    return t["customer"].select("c_custkey", reply.alias("reply"))


query("x18_flatten_record", """
    SELECT c_custkey, 'r' || c_custkey AS id, c_name AS name, c_mktsegment AS segment,
        2 AS attributes FROM customer""")(
    lambda t: crm.flatten_record(crm.open_envelope(crm_records(t), "reply")).select(
        "c_custkey", "id", F.col("attributes")["name"].alias("name"),
        F.col("attributes")["segment"].alias("segment"),
        F.size("attributes").alias("attributes")))


def options(t):
    return t["customer"].select(F.col("c_custkey").alias("id"),
                                F.array("c_mktsegment", F.lit("Podcast")).alias("options"))


def option_updates(t):
    """New options for the customers that ordered: their order states."""
    return t["orders"].groupBy(F.col("o_custkey").alias("id")).agg(
        F.array_sort(F.collect_set(F.concat(F.lit("state "), "o_orderstatus"))).alias("options"))


_STATES = """(SELECT o_custkey, string_agg(DISTINCT 'state ' || o_orderstatus, ','
        ORDER BY 'state ' || o_orderstatus) AS states FROM orders GROUP BY 1)"""
query("l13_crm_append", f"""
    SELECT c_custkey AS id, c_mktsegment || ',Podcast' || coalesce(',' || states, '') AS options
    FROM customer LEFT JOIN {_STATES} ON c_custkey = o_custkey""")(
    lambda t: crm.crm_update(options(t), option_updates(t))
    .select("id", F.array_join("options", ",").alias("options")))
query("l13_crm_overwrite", f"""
    SELECT c_custkey AS id, coalesce(states, c_mktsegment || ',Podcast') AS options
    FROM customer LEFT JOIN {_STATES} ON c_custkey = o_custkey""")(
    lambda t: crm.crm_update(options(t), option_updates(t), overwrite=True)
    .select("id", F.array_join("options", ",").alias("options")))
query("l13_crm_filter", """
    SELECT c_custkey AS id FROM customer WHERE lower(c_mktsegment) = 'machinery'""")(
    lambda t: crm.crm_filter(options(t), "options", ["Machinery"]).select("id"))
