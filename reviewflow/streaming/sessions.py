"""State of mail sessions, kept by key in the state store."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reviewflow.functions.text import email_hash
from reviewflow.streaming.runs import POLL, large_state, to_files

#: Days without mail or closing after which a session is forgotten.
FORGET_DAYS = 90
_DECISION = "email_hash STRING, message_id STRING, received LONG, copies LONG, decision STRING, status STRING"


def _order(*values) -> tuple:
    """Orders values as the planner does: null first."""
    return tuple((v is not None, v) if v is not None else (False, 0) for v in values)


class SessionStatus(StatefulProcessor):
    """The status of the session of one mail hash, and the decision on the mails of a poll.

    Mail without a session opens one (``new``), mail of a completed one is left out (``skip``), other mail is
    tried again (``retry``). Mails of a poll are decided before its closings. A session is forgotten when the
    watermark has passed its last mail or closing; there is one timer a session, set again when it goes off
    too early.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", "status STRING, seen LONG")

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        known = self.state.get()
        due = known is not None and known[1] // 1000 <= timerValues.getCurrentWatermarkInMs()
        status = known[0] if known is not None and not due else None
        copies, first, closing = 0, None, None
        seen = known[1] if known is not None else 0
        for r in rows:
            seen = max(seen, r.received or 0)
            if r.closed_as is None:
                copies += 1
                mail = _order(r.received, r.message_id), r
                first = mail if first is None or mail[0] < first[0] else first
            else:
                end = _order(r.received, r.closed_as), r.closed_as
                closing = end if closing is None or end[0] > closing[0] else closing
        if copies:
            decision = "new" if status is None else "skip" if status == "completed" else "retry"
            status = "completed" if decision == "skip" else "processing"
            yield Row(email_hash=key[0], message_id=first[1].message_id, received=first[1].received, copies=copies,
                      decision=decision, status=status)
        if status is None:
            return
        if known is None:
            self.handle.registerTimer(seen // 1000)
        self.state.update((closing[1] if closing is not None else status, seen))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.state.get()
        if known is not None and known[1] // 1000 > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(known[1] // 1000)
        else:
            self.state.clear()
        return iter(())


def session_state(mails: DataFrame, path: str, closes: DataFrame | None = None, trigger: str | None = POLL,
                  forget_days: int = FORGET_DAYS):
    """Decision per poll and mail hash (new, retry, skip), given out under ``path``.

    ``mails``: message_id, body, sender_email, received_at. ``closes``: email_hash, closed_as,
    received_at, the ends of sessions. A poll reads and writes the state of its own hashes alone. Mail that
    comes ``forget_days`` behind the latest is left out; the query's progress counts it.
    """
    at = F.col("received_at").cast("timestamp").alias("received_at")
    events = mails.select(email_hash(F.col("body"), F.col("sender_email")).alias("email_hash"),
                          F.col("message_id").cast("string"), at, F.lit(None).cast("string").alias("closed_as"))
    if closes is not None:
        events = events.unionByName(closes.select(
            "email_hash", F.lit(None).cast("string").alias("message_id"), at, "closed_as"))
    events = events.withWatermark("received_at", f"{forget_days} days") \
                   .withColumn("received", F.unix_micros("received_at"))
    decided = events.groupBy("email_hash").transformWithState(SessionStatus(), _DECISION, "Append", "EventTime")
    with large_state(mails.sparkSession):
        return to_files(decided.withColumn("received", F.timestamp_micros("received"))
                        .withColumnRenamed("received", "received_at"), path, trigger)
