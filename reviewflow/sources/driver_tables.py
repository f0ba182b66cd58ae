"""Review log tables derived from the order, event and document tables used for checking.

``SPARK`` holds the derivation in Spark SQL, ``DUCK`` the same in the checker's dialect. Tables
are read with fixed schemas and only when asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewflow.functions.ranking import number_in_group
from reviewflow.functions.scores import quality_score, template_score
from reviewflow.session import configure

BASE = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
            "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

_LABEL = """CASE o_orderpriority WHEN '1-URGENT' THEN 'Accepted' WHEN '2-HIGH' THEN 'Conditional'
            WHEN '3-MEDIUM' THEN 'Pay-to-Play' WHEN '5-LOW' THEN 'No Guests' END"""
_NAMED = f"coalesce({_LABEL}, 'Unlabelled')"
_ACTION = """CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'click' THEN 'edited'
             WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'rated'
             ELSE 'editing_initiated' END"""
_RATING = """CASE WHEN event_type IN ('purchase', 'error', 'view')
             THEN CAST(event_id % 5 + 1 AS INT) END"""
_EDITS = "CASE WHEN event_type = 'click' THEN CAST(floor(value) AS INT) ELSE 0 END"
_CLICK = """CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject'
            WHEN 'click' THEN 'edit' WHEN 'view' THEN concat('rate_', event_id % 5 + 1)
            ELSE 'feedback' END"""

# source table, select list; the same text holds in both engines unless DUCK_ONLY says otherwise
_SHARED = {
    "email_sessions": ("orders", f"""
        o_orderkey AS id, {{hash}} AS email_hash,
        concat('user', o_custkey, '@example.com') AS sender_email,
        concat('User ', o_custkey) AS sender_name, concat('Re: ', o_orderpriority) AS subject,
        {_LABEL} AS classification, o_orderdate AS processing_started_at,
        CASE WHEN o_orderstatus <> 'O' THEN {{completed}} END AS processing_completed_at,
        CASE WHEN o_orderstatus <> 'O' THEN CAST(1000 * floor(o_totalprice / 1000) AS INT) END
            AS total_duration_ms,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed'
            ELSE 'processing' END AS status,
        CASE WHEN o_orderstatus = 'P' THEN concat('error ', o_orderkey % 5) END
            AS error_message"""),
    "node_executions": ("lineitem", """
        l_orderkey AS session_id, concat('node_', l_linenumber) AS node_name,
        l_shipdate AS started_at, CAST(floor(l_extendedprice) AS INT) AS duration_ms,
        l_returnflag <> 'R' AS success,
        CASE WHEN l_returnflag = 'R' THEN 'error' END AS error_message"""),
    "classification_results": ("orders", f"""
        o_orderkey AS session_id, {_NAMED} AS predicted_label,
        (o_orderkey % 1000) / 1000.0E0 AS confidence_score,
        CASE WHEN o_orderkey % 10 = 0 THEN 'Others' ELSE {_NAMED} END AS human_verified_label,
        o_orderkey % 10 <> 0 AS is_correct"""),
    "document_extractions": ("lineitem", """
        l_orderkey AS session_id, l_discount >= 0.05E0 AS client_matched,
        CASE WHEN l_discount >= 0.05E0 THEN concat('Client ', l_suppkey % 20) END AS client_name,
        CAST(l_quantity AS INT) AS documents_found, l_linestatus = 'F' AS extraction_success,
        CAST(floor(l_extendedprice) AS INT) AS extraction_duration_ms"""),
    "draft_generations": ("documents", """
        doc_id AS session_id, text AS draft_content,
        CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', 'E') END AS final_draft_content,
        CAST(n_chars AS INT) AS draft_length, lang <> 'en' AS context_used,
        CASE WHEN lang <> 'en' THEN CAST(floor(n_chars / 2.0E0) AS INT) ELSE 0 END
            AS context_length"""),
    "quality_feedback": ("events", f"""
        event_id AS id, CAST(floor(event_id / 2.0E0) AS BIGINT) AS session_id,
        {_ACTION} AS human_action, {_RATING} AS human_rating, {_EDITS} AS edit_distance,
        concat('user', user_id) AS slack_user_name, ts AS created_at,
        props AS interaction_metadata"""),
    "slack_interactions": ("events", f"""
        CAST(floor(event_id / 2.0E0) AS BIGINT) AS session_id,
        CASE WHEN event_type = 'view' THEN 'selection' ELSE 'button_click' END
            AS interaction_type,
        {_CLICK} AS action_value, user_id, concat('user', user_id) AS user_name,
        CAST(floor(value * 10) AS INT) AS response_time_ms, props AS payload,
        ts AS created_at, event_id AS id"""),
    "email_workflows": ("orders", """
        o_orderkey AS session_id,
        CASE o_orderkey % 5 WHEN 0 THEN 'pending_review' WHEN 1 THEN 'approved'
            WHEN 2 THEN 'rejected' WHEN 3 THEN 'edited' ELSE 'draft_created' END
            AS workflow_state,
        concat('step_', o_orderkey % 3) AS current_step"""),
    "prompt_versions": ("part", """
        p_partkey AS id, p_brand AS prompt_name, p_name AS content,
        p_partkey % 7 = 0 AS is_active,
        CAST((p_partkey % 100) / 100.0E0 AS DECIMAL(5,4)) AS performance_score,
        p_size AS usage_count"""),
    "prompt_usage": ("lineitem", """
        l_orderkey AS session_id, l_partkey AS prompt_version_id,
        concat('node_', l_linenumber) AS node_name,
        CAST(floor(l_extendedprice) AS INT) AS execution_time_ms,
        l_returnflag <> 'R' AS success, CAST(l_discount AS DECIMAL(5,4)) AS output_quality_score,
        l_shipdate AS created_at"""),
    "system_metrics": ("events", """
        event_type AS metric_name, value AS metric_value, props AS tags, ts AS timestamp"""),
    "audit_logs": ("events", """
        event_id AS id, concat('user', user_id) AS user_id, event_type AS action,
        'session' AS resource_type, CAST(floor(event_id / 2.0E0) AS BIGINT) AS resource_id,
        props AS new_values, ts AS timestamp, event_type <> 'error' AS success,
        CASE WHEN event_type = 'error' THEN props END AS error_message"""),
    "ab_test_configs": ("part", """
        p_partkey AS id, concat('test ', p_size) AS test_name, p_brand AS prompt_name,
        p_partkey AS variant_a_version_id, p_partkey + 1 AS variant_b_version_id,
        CAST((p_partkey % 100) / 100.0E0 AS DECIMAL(3,2)) AS traffic_split,
        p_partkey % 3 = 0 AS is_active, p_type AS created_by"""),
    "user_sessions": ("orders", """
        o_orderkey AS id, concat('user', o_custkey) AS user_id,
        concat('token ', o_orderkey) AS session_token, o_orderdate AS created_at"""),
    "mails": ("documents", """
        doc_id AS message_id, substr(text, 1, 40) AS subject, text AS body,
        substr(text, 1, 100) AS snippet,
        CASE WHEN doc_id % 10 = 0 THEN 'NoReply@Example.com'
            ELSE concat(lang, '@example.com') END AS sender_email,
        {received} AS received_at"""),
    "email_threads": ("embeddings", """
        vec_id, embedding, concat('thread ', vec_id) AS email_thread"""),
}

_SPELLING = {
    "spark": {
        "hash": "sha2(CAST(o_orderkey AS STRING), 256)",
        "completed": "o_orderdate + make_interval(0,0,0,0,0,0, floor(o_totalprice / 1000))",
        "received": "TIMESTAMP_NTZ'2024-01-01 00:00:00' "
                    "+ make_interval(0,0,0,0,0, CAST(doc_id AS INT), 0)",
    },
    "duck": {
        "hash": "sha256(CAST(o_orderkey AS VARCHAR))",
        "completed": "o_orderdate + to_seconds(CAST(floor(o_totalprice / 1000) AS BIGINT))",
        "received": "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS BIGINT))",
    },
}

_SCORE_SQL = """round_even(CASE WHEN human_action = 'rated' AND human_rating IS NOT NULL
        THEN human_rating / 5.0E0
        ELSE least(1.0E0, (CASE WHEN human_action <> 'approved' THEN 0.0E0
            WHEN edit_distance = 0 THEN 0.6E0 WHEN edit_distance < 50 THEN 0.45E0
            WHEN edit_distance < 200 THEN 0.3E0 ELSE 0.0E0 END)
            + coalesce(human_rating, 0) / 5.0E0 * 0.4E0) END, 4)"""
_TEMPLATE_SQL = """CASE WHEN draft_length < 100 THEN 0.2E0 WHEN draft_length < 200 THEN 0.5E0
        WHEN draft_length <= 500 THEN 1.0E0 WHEN draft_length <= 800 THEN 0.8E0
        ELSE 0.6E0 END"""


def _items(columns: str) -> list[str]:
    """Items of a select list, each on one line."""
    out, depth, item = [], 0, ""
    for c in " ".join(columns.split()):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(item.strip())
            item = ""
        else:
            item += c
    return [*out, item.strip()]


def _select(name: str, dialect: str) -> str:
    source, columns = _SHARED[name]
    spelling = _SPELLING[dialect]
    for key, value in spelling.items():
        columns = columns.replace("{" + key + "}", value)
    return f"SELECT {columns} FROM {source}"


def _duck(name: str) -> str:
    if name == "prompt_templates":
        return "SELECT DISTINCT p_brand AS prompt_name, right(p_brand, 1) AS category FROM part"
    text = _select(name, "duck")
    if name == "quality_feedback":
        return f"SELECT *, {_SCORE_SQL} AS final_quality_score FROM ({text})"
    if name == "draft_generations":
        return f"SELECT *, {_TEMPLATE_SQL} AS template_adherence_score FROM ({text})"
    if name == "prompt_versions":
        return ("SELECT *, CAST(row_number() OVER (PARTITION BY prompt_name ORDER BY id) AS INT)"
                f" AS version FROM ({text})")
    return text


LOG_TABLES = (*_SHARED, "prompt_templates")
# Names of the derived columns, in order.
COLUMNS = {name: re.findall(r"(?:^|AS\s+)([a-z_]+)\s*$", text, re.M) for name, text in {
    name: "\n".join(_items(columns)) for name, (_, columns) in _SHARED.items()}.items()}
COLUMNS["prompt_templates"] = ["prompt_name", "category"]
COLUMNS["prompt_versions"].append("version")
COLUMNS["quality_feedback"].append("final_quality_score")
COLUMNS["draft_generations"].append("template_adherence_score")
DUCK = {name: _duck(name) for name in LOG_TABLES}


class Tables(Mapping):
    """Driver tables and the log tables derived from them, built on first use."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = configure(spark)
        self.path = path.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def __contains__(self, name: object) -> bool:
        return name in BASE or name in LOG_TABLES

    def __iter__(self) -> Iterator[str]:
        return iter((*BASE, *LOG_TABLES))

    def __len__(self) -> int:
        return len(BASE) + len(LOG_TABLES)

    def _build(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.schema(BASE[name]).parquet(f"{self.path}/{name}.parquet")
        if name == "prompt_templates":
            return self["part"].select(
                F.col("p_brand").alias("prompt_name"),
                F.right(F.col("p_brand"), F.lit(1)).alias("category")).distinct()
        source = self[_SHARED[name][0]]
        text = _select(name, "spark").replace(f" FROM {_SHARED[name][0]}", " FROM {source}")
        df = self.spark.sql(text, source=source)
        if name == "quality_feedback":
            df = df.withColumn("final_quality_score", quality_score(
                F.col("human_action"), F.col("human_rating"), F.col("edit_distance")))
        elif name == "draft_generations":
            df = df.withColumn("template_adherence_score", template_score(F.col("draft_length")))
        elif name == "prompt_versions":
            df = number_in_group(df, ["prompt_name"], "id", "version")
        return df


def with_tables(sql: str) -> str:
    """Checker SQL with the derived tables it names put in front as common table expressions."""
    words = set(re.findall(r"[a-z_]+", sql))
    used = [name for name in LOG_TABLES if name in words]
    if not used:
        return sql
    prefix = ",\n".join(f"{name} AS ({DUCK[name]})" for name in used)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {prefix},\n{body[5:]}"
    return f"WITH {prefix}\n{body}"
