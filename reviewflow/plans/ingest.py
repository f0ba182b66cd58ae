"""Intake queries over mail derived from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewflow.functions import text as x
from reviewflow.operators import ingest as g
from reviewflow.plans.registry import query

KEYWORDS, IGNORE = ["token", "TOKEN", "delivery status notification"], ["noreply@example.com"]

# Mail as it comes from the feed: senders, body or snippet, with gaps.
RAW = """
    SELECT CAST(message_id AS {string}) AS message_id,
        CASE WHEN message_id % 7 = 0 THEN '' ELSE subject END AS subject,
        CASE WHEN message_id % 11 = 0 THEN NULL WHEN message_id % 13 = 0 THEN '' ELSE body END AS body,
        CASE WHEN message_id % 22 = 0 THEN NULL ELSE snippet END AS snippet, received_at,
        sender_email AS address, message_id % 4 AS kind FROM {mails}"""
DUCK_RAW = RAW.format(string="VARCHAR", mails="mails")


def raw_mails(t):
    """The raw feed: kind 0 has no sender, 1 no name, 2 an empty name, 3 a full sender."""
    raw = t.spark.sql(RAW.replace("{string}", "STRING"), mails=t["mails"])
    name = F.when(F.col("kind") == 2, "").when(F.col("kind") == 3, "Desk")
    sender = F.struct(F.col("address").alias("email"), name.alias("name"))
    none = F.array().cast("array<struct<email:string,name:string>>")
    return raw.withColumn("senders", F.when(F.col("kind") == 0, none)
                          .otherwise(F.array(sender))).drop("address", "kind")


DUCK_NORMAL = f"""
    SELECT message_id, CASE WHEN subject = '' THEN '(No Subject)' ELSE subject END AS subject,
        coalesce(nullif(body, ''), nullif(snippet, ''), '') AS body, received_at,
        CASE WHEN kind = 0 THEN 'unknown@email.com' ELSE address END AS sender_email,
        CASE kind WHEN 0 THEN 'Unknown' WHEN 3 THEN 'Desk' ELSE split_part(address, '@', 1) END
            AS sender_name FROM ({DUCK_RAW})"""
# Tabs and carriage returns as characters, spelled for the checker.
DUCK_CLEAN = "translate(coalesce({0}, ''), chr(9) || chr(13), ' ' || chr(10))"
DUCK_KEPT = """sender_email <> '' AND lower(sender_email) NOT IN ('noreply@example.com')
    AND NOT contains(lower(subject), 'token') AND NOT contains(lower(body), 'token')
    AND NOT contains(lower(subject), 'TOKEN') AND NOT contains(lower(body), 'TOKEN')
    AND NOT contains(lower(subject), 'delivery status notification')
    AND NOT contains(lower(body), 'delivery status notification')"""
DUCK_INTAKE = f"""
    SELECT message_id, subject, sender_name, sender_email,
        {DUCK_CLEAN.format("'Subject: ' || subject || chr(10) || chr(10) || 'Content: ' || body")}
            AS body, received_at
    FROM ({DUCK_NORMAL}) WHERE {DUCK_KEPT}"""

query("f1_filter_spam", f"SELECT * FROM mails WHERE {DUCK_KEPT}")(
    lambda t: g.filter_spam(t["mails"], KEYWORDS, IGNORE))

query("f2_clean_text", f"""
    SELECT page_id, {DUCK_CLEAN.format("html || chr(13) || chr(10) || chr(9) || url")} AS cleaned
    FROM pages""")(lambda t: t["pages"].select("page_id", x.clean_text(
        F.concat("html", F.lit("\r\n\t"), "url")).alias("cleaned")))

query("f3_mail_body", f"""
    SELECT message_id, coalesce(nullif(body, ''), nullif(snippet, ''), '') AS body
    FROM ({DUCK_RAW})""")(lambda t: g.mail_body(raw_mails(t)).select("message_id", "body"))

query("f4_normalise_mail", DUCK_NORMAL)(
    lambda t: g.normalise_mail(g.mail_body(raw_mails(t))).drop("snippet"))

query("f4_recipient_name", """
    SELECT message_id, CASE WHEN contains(sender_email, '@') THEN split_part(sender_email, '@', 1)
        ELSE '' END AS recipient FROM mails""")(
    lambda t: t["mails"].select(
        "message_id", g.recipient_name(F.col("sender_email")).alias("recipient")))

query("t1_intake_batch", DUCK_INTAKE)(lambda t: g.intake(raw_mails(t), KEYWORDS, IGNORE))

query("x1_email_hash", """
    SELECT message_id, sha256(coalesce(body, '') || '|' || coalesce(sender_email, ''))
        AS email_hash FROM mails""")(lambda t: t["mails"].select(
            "message_id", x.email_hash(F.col("body"), F.col("sender_email")).alias("email_hash")))


def chat_mails(t):
    """A second feed: each conversation turn as a mail."""
    return t["conversations"].select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
        F.col("role").alias("subject"), F.col("text").alias("body"),
        F.concat("role", F.lit("@example.com")).alias("sender_email"))


query("s7_all_mail", """
    SELECT message_id, subject, body, sender_email FROM mails UNION ALL
    SELECT conv_id * 1000 + turn, role, text, role || '@example.com' FROM conversations""")(
    lambda t: g.all_mail(t["mails"].select("message_id", "subject", "body", "sender_email"),
                         chat_mails(t)))


def copied_mails(t):
    """Every mail twice: the second copy an hour later under another subject."""
    later = t["mails"].withColumn("received_at", F.expr("received_at + INTERVAL 1 HOUR")) \
                      .withColumn("subject", F.concat(F.lit("Fwd: "), "subject"))
    return t["mails"].unionByName(later)


query("l2_dedupe_messages", "SELECT * FROM mails")(lambda t: g.dedupe_messages(copied_mails(t)))


def known_sessions(t):
    """Sessions of the mails that already carry labels, one per hash."""
    hashed = t["mails"].select("message_id", x.email_hash(F.col("body"), F.col("sender_email"))
                               .alias("email_hash"))
    return hashed.join(t["labels"], F.col("message_id") == F.col("doc_id")) \
        .groupBy("email_hash").agg(
            F.min("doc_id").alias("id"),
            F.when(F.max("quality") == 1, "completed").when(F.max("toxic") == 1, "failed")
             .otherwise("processing").alias("status"))


DUCK_ADMIT = """
    WITH hashed AS (SELECT *, sha256(coalesce(body, '') || '|' || coalesce(sender_email, ''))
            AS email_hash FROM mails),
        known AS (SELECT email_hash, min(doc_id) AS id,
                CASE WHEN max(quality) = 1 THEN 'completed' WHEN max(toxic) = 1 THEN 'failed'
                    ELSE 'processing' END AS status
            FROM hashed JOIN labels ON message_id = doc_id GROUP BY email_hash),
        batch AS (SELECT email_hash, count(*) OVER (PARTITION BY email_hash) AS copies, message_id,
                received_at, row_number() OVER (PARTITION BY email_hash
                    ORDER BY received_at, message_id) AS n FROM hashed)
    SELECT batch.email_hash, message_id, received_at, copies, known.id AS session_id,
        CASE WHEN known.id IS NULL THEN 'new' WHEN known.status = 'completed' THEN 'skip'
            ELSE 'retry' END AS decision,
        CASE WHEN known.status = 'completed' THEN 'completed' ELSE 'processing' END AS status
    FROM batch LEFT JOIN known ON batch.email_hash = known.email_hash WHERE n = 1"""
query("l1_admit", DUCK_ADMIT)(lambda t: g.admit(t["mails"], known_sessions(t)))

_NOW = "TIMESTAMP '2024-06-01 00:00:00'"
query("l1_sessions_after", f"""
    SELECT coalesce(session_id, message_id) AS id, email_hash, status,
        CASE WHEN decision = 'skip' THEN NULL ELSE {_NOW} END AS processing_started_at
    FROM ({DUCK_ADMIT})""")(lambda t: g.sessions_after(
        known_sessions(t).withColumn("processing_started_at", F.lit(None).cast("timestamp_ntz")),
        g.admit(t["mails"], known_sessions(t)), F.expr(_NOW.replace("TIMESTAMP ", "TIMESTAMP_NTZ")),
        "message_id"))

query("f8_route", """
    SELECT id, CASE WHEN status = 'failed' THEN 'end'
        WHEN classification = 'Pay-to-Play' THEN 'handle_rejection'
        ELSE 'standard_pipeline' END AS route FROM email_sessions""")(
    lambda t: g.route(t["email_sessions"].select(
        "id", F.when(F.col("status") == "failed", " No ").when(F.col("status") == "completed", "nope")
        .alias("decision"),
        F.when(F.col("classification") == "Pay-to-Play", "Topic-based rejection")
         .otherwise(F.col("classification")).alias("label"))).select("id", "route"))

query("f10_fresh_only", """
    SELECT event_id, ts FROM events
    WHERE abs(floor(epoch(ts)) - floor(epoch((SELECT min(ts) + INTERVAL 10 DAY FROM events)))) <= 300
    """)(lambda t: g.fresh_only(
        t["events"].select("event_id", "ts"), "ts",
        t["events"].select(F.expr("min(ts) + INTERVAL 10 DAYS")).scalar()))


def files(t):
    """Parts as files: the brand is the parent, small parts are deleted ones."""
    return t["part"].select(
        F.col("p_partkey").alias("file_id"), F.col("p_brand").alias("parent_id"), F.col("p_name").alias("name"),
        F.when(F.col("p_type").isin("PROMO", "LARGE"), "application/vnd.example.folder")
         .otherwise("application/vnd.example.document").alias("mime_type"),
        (F.col("p_type") == "SMALL").alias("trashed"))


for _kind, _types in (("folder", "('PROMO', 'LARGE')"),
                      ("document", "('ECONOMY', 'STANDARD', 'MEDIUM')")):
    query(f"f11_list_{_kind}s", f"""
        SELECT p_partkey AS file_id, p_brand AS parent_id, p_name AS name FROM part
        WHERE p_brand = 'Brand#17' AND p_type IN {_types}""")(
        lambda t, kind=_kind: g.list_children(files(t), "Brand#17", kind)
        .select("file_id", "parent_id", "name"))
