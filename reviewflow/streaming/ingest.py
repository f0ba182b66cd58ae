"""Continuous mail intake."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reviewflow.operators.ingest import decide, first_copies, intake
from reviewflow.operators.joins import send_if_small
from reviewflow.streaming.runs import POLL, to_batches

MEMORY = "1 hour"
# Mail hashes of a poll that are put into the filter of the log's scan.
SENT_HASHES = 1000

# Log of session states: one row per change, in a folder per poll and step.
_OPENED = """
    id STRING, email_hash STRING, message_id STRING, sender_name STRING, sender_email STRING,
    subject STRING, email_content STRING, decision STRING, status STRING, received_at TIMESTAMP"""
SESSION_LOG = _OPENED + """,
    classification STRING, error_message STRING, batch_id BIGINT, step INT"""


def session_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SESSION_LOG).parquet(f"{path}/log")


def _newest(log: DataFrame) -> DataFrame:
    """The newest row of every session."""
    rest = [c for c in log.columns if c != "id"]
    return log.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("batch_id", "step"))
                                 .alias("_row")).select("id", "_row.*")


def current_sessions(spark: SparkSession, path: str) -> DataFrame:
    return _newest(session_log(spark, path))


def compact_sessions(spark: SparkSession, path: str, out: str) -> None:
    """Write the log anew with one row per session, as the start of a fresh log under ``out``.

    It is in the order of the mail hash, so a poll that names its hashes skips most of it.
    """
    current_sessions(spark, path).drop("batch_id", "step").repartitionByRange("email_hash") \
        .sortWithinPartitions("email_hash").write.mode("errorifexists") \
        .parquet(f"{out}/log/batch_id=-1/step=0")


def run_ingest(mails: DataFrame, path: str, process: Callable[[DataFrame], DataFrame] | None = None,
               keywords: list[str] | None = None, ignore: list[str] | None = None,
               trigger: str | None = POLL):
    """Poll raw mail: clean, filter, hash, admit, and log the session states under ``path``.

    ``process`` stands for the work on an admitted mail. It gets the admitted mails with their
    session id and returns ``session_id, label, error``; those sessions are closed in the same
    poll. Session ids are the mail hash, and a poll rewrites its own folder, so a repeated poll
    leaves the same log.
    """
    spark = mails.sparkSession

    def poll(raw: DataFrame, batch_id: int) -> None:
        mail = intake(raw, keywords, ignore)
        batch = first_copies(mail, ["sender_name", "sender_email", "subject", "body"]).persist()
        seen = session_log(raw.sparkSession, path).filter(F.col("batch_id") < batch_id)
        hashes = [v[0] for v in batch.select("email_hash").limit(SENT_HASHES + 1).collect()]
        if len(hashes) <= SENT_HASHES:
            seen = seen.filter(F.col("email_hash").isin(hashes))
        known = _newest(seen.select("id", "email_hash", "status", "batch_id", "step")
                        .join(send_if_small(batch.select("email_hash")), "email_hash",
                              "left_semi"))
        target = f"{path}/log/batch_id={batch_id}"
        try:
            opened = decide(batch, known).filter(F.col("decision") != "skip") \
                .withColumn("id", F.coalesce("session_id", "email_hash")) \
                .withColumnRenamed("body", "email_content")
            _write(opened, f"{target}/step=0")
        finally:
            batch.unpersist()
        if process is not None:
            opened = raw.sparkSession.read.schema(_OPENED).parquet(f"{target}/step=0")
            done = process(opened.withColumnRenamed("id", "session_id")
                           .withColumnRenamed("email_content", "body"))
            closed = opened.drop("status", "email_content").join(
                done.select(F.col("session_id").alias("id"), F.col("label").alias("classification"),
                            F.col("error").alias("error_message")), "id") \
                .withColumn("status", F.when(F.coalesce("error_message", F.lit("")) == "",
                                             "completed").otherwise("failed"))
            _write(closed, f"{target}/step=1")

    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(_OPENED)]
    _write(spark.range(0).coalesce(1).select(*none), f"{path}/log/batch_id=-2/step=0")
    return to_batches(mails, poll, path, trigger)


def _write(rows: DataFrame, target: str) -> None:
    names = [c.strip().split(" ")[0] for c in SESSION_LOG.split(",")]
    kept = [c for c in names if c in rows.columns and c not in ("batch_id", "step")]
    rows.select(*kept).write.mode("overwrite").parquet(target)


def dedupe_stream(mails: DataFrame, memory: str = MEMORY) -> DataFrame:
    """Each message id once; ids are forgotten after ``memory`` of event time."""
    return mails.withWatermark("received_at", memory) \
                .dropDuplicatesWithinWatermark(["message_id"])
