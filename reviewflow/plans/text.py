"""Scoring and text expression queries over whole texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from reviewflow.functions import scores as sc
from reviewflow.functions import text as x
from reviewflow.functions.vectors import decode_vector
from reviewflow.operators import retrieval as rv
from reviewflow.operators import review as r
from reviewflow.operators import scan
from reviewflow.plans.registry import query

query("x2_template_score", """
    SELECT doc_id, CASE WHEN n < 100 THEN 0.2E0 WHEN n < 200 THEN 0.5E0 WHEN n <= 500 THEN 1.0E0
        WHEN n <= 800 THEN 0.8E0 ELSE 0.6E0 END AS score
    FROM (SELECT doc_id, coalesce(nullif(n_chars * (doc_id % 2), 0), n_chars // 2) AS n
          FROM documents)""")(
    lambda t: t["documents"].select("doc_id", sc.template_score(sc.scored_length(
        F.col("n_chars") * (F.col("doc_id") % 2), F.floor(F.col("n_chars") / 2))).alias("score")))

query("x3_quality_score", "SELECT id, final_quality_score FROM quality_feedback")(
    lambda t: t["quality_feedback"].select("id", "final_quality_score"))

query("x4_edit_type", """
    SELECT event_id, CASE WHEN d <= 0 THEN NULL WHEN d < 50 THEN 'minor' WHEN d < 200 THEN 'major'
        ELSE 'complete_rewrite' END AS edit_type
    FROM (SELECT event_id, CAST(floor(value * 3) AS INT) AS d FROM events)""")(
    lambda t: t["events"].select("event_id", sc.edit_type(
        F.floor(F.col("value") * 3).cast("int")).alias("edit_type")))

# A draft without an edit is compared with itself; both get an addition.
query("x5_edit_distance", """
    SELECT session_id, CASE WHEN final_draft_content IS NULL THEN 0
            ELSE length(draft_content) - length(replace(draft_content, 'e', '')) END
            + length(' p.s.') AS distance
    FROM draft_generations""")(
    lambda t: t["draft_generations"].select(
        "session_id", sc.edit_distance(F.col("draft_content"), F.concat(
            F.coalesce("final_draft_content", "draft_content"), F.lit(" p.s.")))
        .cast("long").alias("distance")))

_GREET = " OR ".join(f"starts_with(low, '{g}')" for g in sc.GREETINGS)
_CLOSE = " OR ".join(f"contains(low, '{c}')" for c in sc.CLOSINGS)
query("x6_draft_indicators", f"""
    SELECT doc_id, CAST({_GREET} AS INT) + CAST({_CLOSE} AS INT)
            + CAST(contains(low, 'tion') AS INT) AS indicators
    FROM (SELECT doc_id, lower(CASE lang WHEN 'en' THEN 'Dear host, ' ELSE '' END || text
        || CASE WHEN doc_id % 2 = 0 THEN ' Thank you' ELSE '' END) AS low FROM documents)""")(
    lambda t: t["documents"].select("doc_id", sc.draft_indicators(F.expr(
        "concat(CASE lang WHEN 'en' THEN 'Dear host, ' ELSE '' END, text, "
        "CASE WHEN doc_id % 2 = 0 THEN ' Thank you' ELSE '' END)"), "Tion").alias("indicators")))

SIGNATURE, ENDINGS = "\n\nBest regards,\nThe desk", ["Best regards,", "The desk", "an."]
query("x7_with_signature", r"""
    SELECT doc_id, CASE WHEN ends_with(trimmed, 'Best regards,') OR ends_with(trimmed, 'The desk')
            OR ends_with(trimmed, 'an.') THEN text
        ELSE trimmed || chr(10) || chr(10) || 'Best regards,' || chr(10) || 'The desk' END AS draft
    FROM (SELECT doc_id, text, regexp_replace(text, '\s+$', '') AS trimmed FROM documents)""")(
    lambda t: t["documents"].select(
        "doc_id", sc.with_signature(F.col("text"), SIGNATURE, ENDINGS).alias("draft")))

_CONTEXT = "chr(10) || chr(10) || 'Additional Client Context from Documents:' || chr(10)"
query("x8_render", f"""
    SELECT doc_id, 'Reply to ' || text || ' on ' || source || ', ' || 'No specific angle available'
        || ' like ' || lang || chr(10) || chr(10) || source || CASE WHEN lang <> 'en' THEN {_CONTEXT} || substr(text, 1, 2000) || '...' ELSE '' END
        AS prompt FROM documents""")(
    lambda t: t["documents"].select("doc_id", x.with_context(
        x.render(F.lit("Reply to {{email}} on {{angle1}}, {{angle2}} like {samples}"), {
            "{samples}": x.samples(F.array("lang", "source")),
            "{{email}}": F.col("text"), "{{angle1}}": x.angle(F.array("source"), 0),
            "{{angle2}}": x.angle(F.array("source"), 1)}),
        F.when(F.col("lang") != "en", F.col("text")), 2000).alias("prompt")))

# Replies of a model as free text around an object, one in four cut off, one in four without any.
_REPLY = """concat(replace(replace(text, '{', ''), '}', ''), CASE doc_id % 4
    WHEN 0 THEN concat(' {"folder_id": "', source, '", "n": {"v": ', n_chars, '}} ok')
    WHEN 1 THEN concat(' {"folder_id": "', source, '"} and {"n": 1}')
    WHEN 2 THEN concat(' {"rejection_type": "Soft Rejection", "angles": ["', lang, '", "b"]} end')
    ELSE ' nothing' END)"""
query("x9_extract_json", """
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source END AS folder_id,
        CASE doc_id % 4 WHEN 1 THEN 'bad_json' WHEN 3 THEN 'no_json' END AS status
    FROM documents""")(
    lambda t: t["documents"].select(
        "doc_id", x.extract_json(F.expr(_REPLY), "folder_id STRING").alias("_r"))
    .select("doc_id", F.col("_r.value.folder_id"), F.col("_r.status")))

query("x10_rejection_parse", """
    SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN 'Soft Rejection' ELSE 'Hard Rejection' END
            AS rejection_type,
        CASE doc_id % 4 WHEN 2 THEN lang || '|b' ELSE '' END AS angles FROM documents""")(
    lambda t: t["documents"].select("doc_id", x.rejection_parse(F.expr(_REPLY)).alias("_r"))
    .select("doc_id", "_r.rejection_type", F.array_join("_r.angles", "|").alias("angles")))

query("x11_tagged_body", r"""
    SELECT doc_id, CASE WHEN lang = 'en' THEN regexp_replace(text, '^\s+|\s+$', '', 'g')
        ELSE '<response>' || text END AS body FROM documents""")(
    lambda t: t["documents"].select("doc_id", x.tagged_body(F.expr(
        "CASE WHEN lang = 'en' THEN concat('<analysis>a</analysis><response> ', text, "
        "'\n</response>') ELSE concat('<response>', text) END")).alias("body")))

query("x12_label_from_notice", """
    SELECT id, coalesce(classification, 'N/A') AS label FROM email_sessions""")(
    lambda t: t["email_sessions"].select("id", x.label_from_notice(F.when(
        F.col("classification").isNotNull(),
        F.concat("subject", F.lit("\n\nClassification:  "), "classification", F.lit(" \nend")))
        .otherwise(F.col("subject"))).alias("label")))

query("x13_preview", """
    SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END
            AS short,
        CASE WHEN length(text) > 3000 THEN substr(text, 1, 3000) || '... [truncated]'
            ELSE text END AS long FROM documents""")(
    lambda t: t["documents"].select(
        "doc_id", x.preview(F.col("text"), 300).alias("short"),
        x.preview(F.col("text"), 3000, "... [truncated]").alias("long")))

query("x14_pretty_name", """
    SELECT p_partkey, upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' '
        || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) || ' '
        || p_type AS display FROM part""")(
    lambda t: t["part"].select("p_partkey", x.pretty_name(F.concat_ws(
        "_", F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_type"))).alias("display")))

query("x15_session_from_action", """
    SELECT event_id, CASE event_type WHEN 'view' THEN 'session' || lpad(user_id::VARCHAR, 4, '0')
        WHEN 'click' THEN 'session' || lpad(user_id::VARCHAR, 5, '0') END AS session_id
    FROM events""")(
    lambda t: t["events"].select("event_id", x.session_from_action(
        F.expr("CASE event_type WHEN 'view' THEN concat('rate_q_session', lpad(user_id, 4, '0')) "
               "WHEN 'click' THEN 'edit_now' ELSE 'x' END"),
        F.expr("CASE event_type WHEN 'click' THEN concat('edit_session', lpad(user_id, 5, '0'), "
               "'_longer_than_eight') WHEN 'view' THEN 'rate_5_zzzzzzzzz' ELSE 'none' END"))
        .alias("session_id")))


def click_payloads(t):
    """A click payload for each event, as the chat service sends it."""
    value = F.expr("""CASE event_type WHEN 'purchase' THEN concat('approve_session', lpad(event_id, 8, '0'))
        WHEN 'view' THEN concat('rate_', event_id % 5 + 1, '_session', lpad(event_id, 8, '0'))
        WHEN 'click' THEN concat('edit_session', lpad(event_id, 8, '0')) ELSE 'help' END""")
    direct, listed = F.col("event_type") != "view", F.col("event_type") == "view"
    action = F.struct(
        F.lit("act").alias("action_id"),
        F.when(direct, "button").otherwise("static_select").alias("type"),
        F.when(direct, value).alias("value"),
        F.when(listed, F.struct(value.alias("value"))).alias("selected_option"))
    body = F.struct(
        F.lit("block_actions").alias("type"), F.concat(F.lit("t"), "event_id").alias("trigger_id"),
        F.struct(F.concat(F.lit("U"), "user_id").alias("id"),
                 F.concat(F.lit("user"), "user_id").alias("name")).alias("user"),
        F.struct(F.lit("C1").alias("id")).alias("channel"),
        F.when(F.col("event_type") == "signup", F.array().cast(
            "array<struct<action_id:string,type:string,value:string,selected_option:struct<value:string>>>"))
         .otherwise(F.array(action)).alias("actions"))
    return t["events"].select("event_id", F.col("ts").alias("created_at"),
                              F.to_json(body).alias("payload"))


query("x16_parse_interactions", """
    SELECT event_id, created_at, 'session' || lpad(event_id::VARCHAR, 8, '0') AS session_id,
        CASE WHEN event_type = 'view' THEN 'selection' ELSE 'button_click' END AS interaction_type,
        CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'view' THEN 'rate' ELSE 'edit' END
            AS action_value,
        'U' || user_id AS user_id, 'user' || user_id AS user_name, 'C1' AS channel_id,
        '' AS message_ts, 't' || event_id AS trigger_id
    FROM (SELECT *, ts AS created_at FROM events)
    WHERE event_type IN ('purchase', 'view', 'click')""")(
    lambda t: r.parse_interactions(click_payloads(t)).drop("payload"))


def button_payloads(t):
    """Button clicks whose value is JSON."""
    kind = F.expr("CASE event_type WHEN 'purchase' THEN 'approve_draft' WHEN 'click' THEN "
                  "'edit_draft' WHEN 'error' THEN 'reject_draft' WHEN 'view' THEN "
                  "concat('rate_', event_id % 5 + 1) ELSE 'unknown' END")
    value = F.to_json(F.struct(
        F.concat(F.lit("session"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("session_id"),
        F.when(F.col("event_type") == "view", (F.col("event_id") % 5 + 1).cast("int")).alias("rating")))
    body = F.struct(
        F.struct(F.concat(F.lit("U"), "user_id").alias("id"),
                 F.concat(F.lit("user"), "user_id").alias("name")).alias("user"),
        F.array(F.struct(kind.alias("action_id"), value.alias("value"))).alias("actions"))
    return t["events"].select("event_id", F.to_json(body).alias("payload"))


query("x17_feedback_from_clicks", """
    SELECT event_id, 'session' || lpad(event_id::VARCHAR, 8, '0') AS session_id, human_action,
        human_rating, 0 AS edit_distance, CAST(NULL AS VARCHAR) AS edit_type,
        round_even(CASE human_action WHEN 'approved' THEN 0.6E0 + 5 / 5.0E0 * 0.4E0
            WHEN 'rejected' THEN 1 / 5.0E0 * 0.4E0 WHEN 'rated' THEN human_rating / 5.0E0
            ELSE 0.0E0 END, 4) AS final_quality_score,
        'session0' AS slack_message_id, 'U' || user_id AS slack_user_id,
        'user' || user_id AS slack_user_name
    FROM (SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 'approved'
                WHEN 'click' THEN 'edited' WHEN 'error' THEN 'rejected'
                WHEN 'view' THEN 'rated' END AS human_action,
            CAST(CASE event_type WHEN 'purchase' THEN 5 WHEN 'error' THEN 1
                WHEN 'view' THEN event_id % 5 + 1 END AS INT) AS human_rating FROM events)
    WHERE human_action IS NOT NULL""")(lambda t: r.feedback_from_clicks(button_payloads(t)))

DEPTHS = 12
query("x19_doc_text", f"""
    SELECT doc_id, source || array_to_string(list_transform(
            range(doc_id % {DEPTHS} + 1, 0, -1), lambda k: k || ':'), '') || text || lang AS text
    FROM documents""")(lambda t: rv.doc_text(document_trees(t)))


def document_trees(t):
    """Each document as a tree: a paragraph, one to twelve tables inside each other, each with a numbered
    cell before the next and the text in the innermost, and a paragraph."""
    content = lambda c: F.to_json(F.struct(c.cast("string").alias("content")))
    paragraph = lambda c: F.concat(
        F.lit('{"paragraph":{"elements":[{"textRun":'), content(c), F.lit('},{"inlineObject":{}}]}}'))
    nested = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.col("doc_id") % DEPTHS + 1), paragraph(F.col("text")),
        lambda inner, k: F.concat(
            F.lit('{"sectionBreak":{}},{"table":{"tableRows":[{"tableCells":[{"content":['),
            paragraph(F.concat(k.cast("string"), F.lit(":"))), F.lit(']},{"content":['), inner,
            F.lit(']}]}]}}')))
    return t["documents"].select("doc_id", F.concat(
        F.lit("["), paragraph(F.col("source")), F.lit(","), nested, F.lit(","), paragraph(F.col("lang")),
        F.lit("]")).alias("content"))


def vector_blobs(t):
    """Vectors as base64 text, half of them wrapped."""
    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: v.astype("<f4").tobytes())

    blob = F.base64(pack("embedding"))
    return t["embeddings"].select("vec_id", F.when(
        F.col("vec_id") % 2 == 0, F.concat(F.lit('{"$binary": "'), blob, F.lit('"}')))
        .otherwise(blob).alias("blob"))


query("x20_decode_vector", """
    SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos,
        CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings""")(
    lambda t: decode_vector(vector_blobs(t), "blob")
    .select("vec_id", F.posexplode("vector").alias("pos", "_v"))
    .select("vec_id", "pos", F.col("_v").cast("double").alias("value")))

query("x21_embed_text", "SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents")(
    lambda t: t["documents"].select("doc_id", x.embed_text(F.col("text")).alias("text")))


def form_states(t):
    """Review forms; a customer of nation 3 left the body out."""
    field = lambda **cols: F.struct(*[v.alias(k) for k, v in cols.items()])
    mail = F.concat("c_name", F.lit("@example.com"))
    blocks = F.map_from_arrays(
        F.array(F.lit("b1"), F.lit("b2"), F.lit("b3")),
        F.array(F.create_map(F.lit("to"), F.to_json(field(initial_value=F.lit("x@y"), value=mail))),
                F.create_map(F.lit("subject"), F.to_json(field(initial_value=F.lit("Re"), value=F.col("c_mktsegment")))),
                F.create_map(F.lit("body"), F.to_json(field(
                    multiline=F.lit(True), value=F.when(F.col("c_nationkey") != 3, F.col("c_name")))))))
    text = F.regexp_replace(F.replace(F.to_json(F.struct(blocks.alias("values"))), F.lit('\\"'), F.lit('"')),
                            r'"(\{[^{}]*\})"', "$1")
    return t["customer"].select("c_custkey", text.alias("state"))


query("x22_parse_form", """
    SELECT c_custkey, c_name || '@example.com' AS recipient, c_mktsegment AS subject,
        CASE WHEN c_nationkey <> 3 THEN c_name END AS body,
        CASE WHEN c_nationkey = 3 THEN 'incomplete form' END AS error FROM customer""")(
    lambda t: rv.parse_form(form_states(t)))

query("v6_clean_label", r"""
    SELECT id, coalesce(classification, 'unknown label') AS label FROM email_sessions""")(
    lambda t: t["email_sessions"].select("id", x.label_clean(F.concat(
        F.lit(" \n"), F.coalesce("classification", F.lit("unknown label")), F.lit("\t "))).alias("label")))

_CUE = """CASE o_orderpriority WHEN '1-URGENT' THEN 'We''d Love to have you on the show'
    WHEN '2-HIGH' THEN 'Yes, we''d love to have them, but a few questions first'
    WHEN '3-MEDIUM' THEN 'Paid slots only' WHEN '5-LOW' THEN 'Sorry, we do not allow guests'
    ELSE concat('order ', o_orderkey) END"""
query("v5_classify_rules", """
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Accepted'
        WHEN '2-HIGH' THEN 'Conditional' WHEN '3-MEDIUM' THEN 'Pay-to-Play'
        WHEN '5-LOW' THEN 'No Guests' ELSE 'Others' END AS label FROM orders""")(
    lambda t: scan.classify_rules(t["orders"].select("o_orderkey", F.expr(_CUE).alias("text")))
    .drop("text"))

_WORDS = (("No Guests", ("the of",)), ("Accepted", ("and the", "of the")), ("Conditional", ("token",)))
query("v5_classify_documents", """
    SELECT doc_id, CASE WHEN contains(lower(text), 'the of') THEN 'No Guests'
        WHEN contains(lower(text), 'and the') OR contains(lower(text), 'of the') THEN 'Accepted'
        WHEN contains(lower(text), 'token') THEN 'Conditional' ELSE 'Others' END AS label
    FROM documents""")(
    lambda t: scan.classify_rules(t["documents"], _WORDS).select("doc_id", "label"))


def _scan_sql(source: str, patterns: dict[str, str], keep: str = "true") -> str:
    """Matches with their line: line feeds in the pieces before, and in earlier matches."""
    parts = []
    for kind, pattern in patterns.items():
        regex = "(?i)" + pattern.replace("'", "''")
        parts.append(f"""
            SELECT id, '{kind}' AS type, text, regexp_extract_all(text, '{regex}') AS found,
                string_split_regex(text, '{regex}') AS pieces FROM source_text""")
    feeds = "length({0}) - length(replace({0}, chr(10), ''))"
    return f"""
        WITH source_text AS ({source}), scanned AS ({' UNION ALL '.join(parts)}),
        placed AS (SELECT id, type, found, pieces, unnest(range(1, len(found) + 1)) AS n FROM scanned)
        SELECT id, type, found[n] AS match,
            CAST(1 + {feeds.format("array_to_string(pieces[1:n], '')")}
                + {feeds.format("array_to_string(found[1:n-1], '')")} AS INT) AS line
        FROM placed WHERE {keep}"""


_REAL = " AND ".join(f"NOT contains(lower(found[n]), '{w}')" for w in scan.PLACEHOLDERS)
query("v3_scan_secrets", f"""
    SELECT id AS doc_id, type, line,
        CASE WHEN length(match) > 50 THEN substr(match, 1, 50) || '...' ELSE match END AS text
    FROM ({_scan_sql('SELECT doc_id AS id, text FROM documents', scan.SECRET_PATTERNS, _REAL)})""")(
    lambda t: scan.scan_secrets(t["documents"]))

_CODE = """concat(text, '\n', CASE doc_id % 5 WHEN 0 THEN concat('q = f"SELECT ', source, ' {lang}"')
    WHEN 1 THEN concat('q = "SELECT ', source, '" % (lang)') WHEN 2 THEN '"{}".format("select 1")'
    WHEN 3 THEN 'cursor.execute("a" + b)' ELSE 'cursor.execute(q, args)' END, '\n')"""
query("v4_scan_unsafe_queries", "SELECT id AS doc_id, type, line, match FROM (" + _scan_sql(
    f"SELECT doc_id AS id, {_CODE} AS text FROM documents".replace("'\n'", "chr(10)"),
    scan.UNSAFE_QUERY_PATTERNS) + ")")(
    lambda t: scan.scan_patterns(t["documents"].select(
        "doc_id", F.expr(_CODE.replace("\n'", "\\n'")).alias("text"))))

HTML_PATTERNS = {"link": r'<a href="[^"]*"', "script": r"<script>.*</script>",
                 "parameter": r"[?&]ref=[a-z]+"}
query("v4_scan_pages", "SELECT id AS page_id, type, line, match FROM (" + _scan_sql(
    "SELECT page_id AS id, html || chr(10) || url AS text FROM pages", HTML_PATTERNS) + ")")(
    lambda t: scan.scan_patterns(t["pages"].select("page_id", F.concat(
        "html", F.lit("\n"), "url").alias("text")), HTML_PATTERNS, "page_id"))
