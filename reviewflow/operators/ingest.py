"""Mail intake: filter, normalise, hash, deduplicate, admit."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewflow.functions.text import clean_text, email_hash

# Words that mark junk and senders to ignore by default.
SPAM_KEYWORDS = [
    "delivery status notification", "drink-mouth", "uncle-quite", "sheep-dress", "shown-shown",
    "meant-funny", "state-forth", "whale-floor", "saved-blood", "maybe-least",
]
IGNORED_SENDERS = ["workspace-noreply@google.com", "payments-noreply@google.com"]
# Text for what a mail lacks.
NO_SENDER, NO_NAME, NO_SUBJECT = "unknown@email.com", "Unknown", "(No Subject)"
# Labels that lead to the rejection branch.
REJECTION_LABELS = ("Identity-based rejection", "Topic-based rejection",
                    "Qualification-based rejection")
# Seconds an event may lie from the reference time.
FRESH_SECONDS = 300


def filter_spam(df: DataFrame, keywords: list[str] | None = None,
                ignore: list[str] | None = None) -> DataFrame:
    """Drop mail without sender, from an ignored sender, or holding a junk word.

    Senders compare without case. Words are looked up as given in the lower-cased subject and
    body, so a word with capitals never hits. The default ignore list holds the two service
    senders; add the mailbox's own address.
    """
    keywords = SPAM_KEYWORDS if keywords is None else keywords
    ignore = IGNORED_SENDERS if ignore is None else ignore
    sender = F.col("sender_email")
    keep = F.coalesce(sender, F.lit("")) != ""
    if ignore:
        keep = keep & ~F.lower(sender).isin([s.lower() for s in ignore])
    if keywords:
        texts = F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in ("subject", "body")])
        holds = lambda text: reduce(or_, [text.contains(word) for word in keywords])
        keep = keep & ~F.exists(texts, holds)
    return df.filter(keep)


def mail_body(df: DataFrame, out: str = "body") -> DataFrame:
    """Body, else snippet, else empty."""
    text = F.coalesce(F.nullif("body", F.lit("")), F.nullif("snippet", F.lit("")), F.lit(""))
    return df.withColumn(out, text)


def normalise_mail(df: DataFrame) -> DataFrame:
    """Sender and subject with defaults from the first entry of ``senders``."""
    first = F.get(F.col("senders"), F.lit(0))
    sender = F.coalesce(first["email"], F.lit(NO_SENDER))
    local = F.substring_index(F.col("sender_email"), "@", 1)
    name = F.when(first.isNull(), F.lit(NO_NAME)) \
            .otherwise(F.coalesce(F.nullif(first["name"], F.lit("")), local))
    return df.withColumn("sender_email", sender).withColumn("sender_name", name) \
             .withColumn("subject", F.coalesce(F.nullif("subject", F.lit("")), F.lit(NO_SUBJECT))) \
             .drop("senders")


def recipient_name(address: Column) -> Column:
    """The part before ``@``, empty when there is none."""
    return F.when(address.contains("@"), F.substring_index(address, "@", 1)).otherwise(F.lit(""))


def combined_text(subject: Column, body: Column) -> Column:
    return clean_text(F.concat(F.lit("Subject: "), subject, F.lit("\n\nContent: "), body))


def intake(raw: DataFrame, keywords: list[str] | None = None,
           ignore: list[str] | None = None) -> DataFrame:
    """Raw mail to mail records: body, sender, junk filter, combined text."""
    mail = filter_spam(normalise_mail(mail_body(raw)), keywords, ignore)
    return mail.select("message_id", "subject", "sender_name", "sender_email",
                       combined_text(F.col("subject"), F.col("body")).alias("body"),
                       "received_at")


def all_mail(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second, allowMissingColumns=True)


def dedupe_messages(df: DataFrame) -> DataFrame:
    """The earliest copy of every message id."""
    others = [c for c in df.columns if c != "message_id"]
    first = F.min_by(F.struct(*others), F.struct("received_at", *[
        c for c in others if c != "received_at"]))
    return df.groupBy("message_id").agg(first.alias("_mail")) \
             .select("message_id", "_mail.*").select(*df.columns)


def first_copies(mails: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One row per mail hash: its earliest mail, with the ``carry`` columns, and the copies.

    Copies are combined before the shuffle, so a mail copied very often is a single row.
    """
    hashed = mails.withColumn("email_hash", email_hash(F.col("body"), F.col("sender_email")))
    order = F.struct("received_at", "message_id")
    first = F.min_by(F.struct("received_at", "message_id", *carry), order) if carry \
        else F.min(order)
    return hashed.groupBy("email_hash").agg(
        first.alias("_first"), F.count(F.lit(1)).alias("copies")) \
        .select("email_hash", "copies", "_first.*")


def decide(batch: DataFrame, sessions: DataFrame) -> DataFrame:
    """New, skip or retry for each hash of ``batch``, from the session that has the hash."""
    known = sessions.select(F.col("email_hash").alias("_hash"), F.col("id").alias("session_id"),
                            F.col("status").alias("_status"))
    seen = F.col("session_id").isNotNull()
    done = F.coalesce(F.col("_status") == "completed", F.lit(False))
    return batch.join(known, F.col("email_hash") == F.col("_hash"), "left").select(
        *batch.columns, "session_id",
        F.when(~seen, "new").when(done, "skip").otherwise("retry").alias("decision"),
        F.when(seen & done, F.col("_status")).otherwise("processing").alias("status"))


def admit(mails: DataFrame, sessions: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """What to do with each distinct mail: new, skip or retry.

    A hash not seen is new; one seen in a completed session is skipped; any other is retried under
    its session id, back in processing with a new start.
    """
    return decide(first_copies(mails, carry), sessions)


def sessions_after(sessions: DataFrame, admitted: DataFrame, as_of: Column,
                   new_id: str = "email_hash") -> DataFrame:
    """Session table after an admission: retried ones start again, new ones are added."""
    again = admitted.filter(F.col("decision") == "retry").select(
        F.col("session_id").alias("_retried"))
    retried = F.col("_retried").isNotNull()
    changed = {"status": F.lit("processing"), "processing_started_at": as_of}
    old = sessions.join(again, F.col("id") == F.col("_retried"), "left").select(*[
        F.when(retried, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
        for c in sessions.columns])
    new = admitted.filter(F.col("decision") == "new") \
        .withColumn("id", F.col(new_id)).withColumn("processing_started_at", as_of)
    return old.unionByName(new.select(*[c for c in sessions.columns if c in new.columns]),
                           allowMissingColumns=True)


def route(df: DataFrame) -> DataFrame:
    """Branch of each mail from the continuation answer and the label."""
    stop = F.lower(F.regexp_replace("decision", r"^\s+|\s+$", "")) == "no"
    rejected = F.col("label").isin(*REJECTION_LABELS)
    return df.withColumn("route", F.when(F.coalesce(stop, F.lit(False)), "end")
                         .when(F.coalesce(rejected, F.lit(False)), "handle_rejection")
                         .otherwise("standard_pipeline"))


def fresh_only(df: DataFrame, time_col: str, as_of: Column,
               seconds: int = FRESH_SECONDS) -> DataFrame:
    """Events at most ``seconds`` before or after the reference time."""
    whole = lambda c: F.unix_seconds(c.cast("timestamp"))
    return df.filter(F.abs(whole(F.col(time_col)) - whole(as_of)) <= seconds)


def list_children(files: DataFrame, parent, kind: str | None = None) -> DataFrame:
    """Files of a parent that are not deleted; ``kind`` is looked up inside the type."""
    found = files.filter((F.col("parent_id") == parent) & ~F.coalesce("trashed", F.lit(False)))
    return found if kind is None else found.filter(F.col("mime_type").contains(kind))
