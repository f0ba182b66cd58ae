"""Review figures and clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewflow.functions.binding import let
from reviewflow.functions.period import as_of_column, hours_between, within
from reviewflow.functions.scores import edit_type, quality_score
from reviewflow.functions.text import before_underscore, session_from_action
from reviewflow.operators.dashboard import rows
from reviewflow.operators.joins import send_if_small
from reviewflow.operators.sessions import COMPLETED, STARTED, _pick, _wanted

# Ratings an approval and a rejection stand for.
APPROVAL_RATING, REJECTION_RATING = 5, 1


def interaction_stats(t, days: int = 30, as_of=None, approx: bool = False) -> DataFrame:
    users = F.approx_count_distinct("user_id") if approx else F.count_distinct("user_id")
    return within(t["slack_interactions"], "created_at", as_of, days, closed=True) \
        .groupBy("interaction_type", "action_value").agg(
            rows().alias("interaction_count"), users.alias("unique_users"),
            F.coalesce(F.avg("response_time_ms"), F.lit(0.0)).alias("avg_response_time")) \
        .orderBy(F.desc("interaction_count"))


def reviewer_engagement(t, days: int = 30, as_of=None) -> DataFrame:
    action = F.col("action_value")
    clicked = F.when(F.col("interaction_type") == "button_click", F.col("response_time_ms"))
    return within(t["slack_interactions"], "created_at", as_of, days, closed=True) \
        .groupBy("user_name").agg(
            rows().alias("total_interactions"),
            F.count_distinct("session_id").alias("sessions_reviewed"),
            F.avg(clicked).alias("avg_response_time"),
            F.count_if(action.like("rate_%")).alias("ratings_given"),
            F.count_if(action == "approve").alias("approvals"),
            F.count_if(action == "reject").alias("rejections")) \
        .orderBy(F.desc("total_interactions"))


# Size of the sketches of distinct counts: a standard error of 0.8 per cent in 16 kB.
SKETCH_K = 14


def interaction_days(clicks: DataFrame) -> DataFrame:
    """Per day, type and action: count, sum and number of response times, and a sketch of the users.

    A day is counted once, when it is over; figures of any period merge the rows of its days.
    """
    return clicks.groupBy(F.to_date("created_at").alias("day"), "interaction_type", "action_value").agg(
        rows().alias("n"), F.sum(F.col("response_time_ms").cast("long")).alias("ms"),
        F.count("response_time_ms").alias("timed"),
        F.hll_sketch_agg("user_id", F.lit(SKETCH_K)).alias("users"))


def _whole_days(days: DataFrame, n: int, last) -> DataFrame:
    """The days of a trailing window that ends with ``last``, by default the latest day there is."""
    end = days.select(F.max("day")).scalar() if last is None else F.lit(last).cast("date")
    return days.filter((F.col("day") <= end) & (F.col("day") >= F.date_sub(end, n)))


def interaction_stats_of_days(days: DataFrame, n: int = 30, last=None) -> DataFrame:
    """``interaction_stats`` over whole days from ``interaction_days``; users are estimated."""
    return _whole_days(days, n, last).groupBy("interaction_type", "action_value").agg(
        F.sum("n").alias("interaction_count"),
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("unique_users"),
        F.coalesce(F.sum("ms") / F.nullif(F.sum("timed"), F.lit(0)), F.lit(0.0)).alias("avg_response_time"))


def engagement_days(clicks: DataFrame) -> DataFrame:
    """Per day and reviewer: the counts of ``reviewer_engagement`` and a sketch of the sessions."""
    action, clicked = F.col("action_value"), F.col("interaction_type") == "button_click"
    ms = F.when(clicked, F.col("response_time_ms"))
    return clicks.groupBy(F.to_date("created_at").alias("day"), "user_name").agg(
        rows().alias("n"), F.sum(ms.cast("long")).alias("ms"), F.count(ms).alias("timed"),
        F.count_if(action.like("rate_%")).alias("ratings"), F.count_if(action == "approve").alias("approvals"),
        F.count_if(action == "reject").alias("rejections"),
        F.hll_sketch_agg("session_id", F.lit(SKETCH_K)).alias("sessions"))


def engagement_of_days(days: DataFrame, n: int = 30, last=None) -> DataFrame:
    """``reviewer_engagement`` over whole days from ``engagement_days``; sessions are estimated."""
    return _whole_days(days, n, last).groupBy("user_name").agg(
        F.sum("n").alias("total_interactions"),
        F.hll_sketch_estimate(F.hll_union_agg("sessions")).alias("sessions_reviewed"),
        (F.sum("ms") / F.nullif(F.sum("timed"), F.lit(0))).alias("avg_response_time"),
        F.sum("ratings").alias("ratings_given"), F.sum("approvals").alias("approvals"),
        F.sum("rejections").alias("rejections"))


def _percent(part: Column, whole: Column) -> Column:
    """Per cent with two decimals, decimal arithmetic, halves up."""
    share = part.cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)") / whole.cast("decimal(20,0)")
    return F.round(share, 2).cast("double")


def approval_rates(t, days: int = 30, as_of=None) -> DataFrame:
    """Review outcome per label; a session counts once per feedback row, or once if it has none.

    Feedback is cut to the sessions of the window and counted per session before the join, so a
    session with very many rows is one row.
    """
    acted = lambda a: F.count_if(F.col("human_action") == a).alias(a)
    recent = within(t["email_sessions"], COMPLETED, as_of, days, closed=True, as_of_from=STARTED) \
        .select("id", "classification")
    counts = t["quality_feedback"].select("session_id", "human_action") \
        .join(send_if_small(recent.select("id")), F.col("session_id") == F.col("id"), "left_semi") \
        .groupBy("session_id").agg(
            rows().alias("_rows"), acted("approved"), acted("rejected"), acted("edited"))
    total = lambda c, none=0: F.sum(F.coalesce(c, F.lit(none)))
    rates = recent.join(counts, F.col("id") == F.col("session_id"), "left") \
        .groupBy("classification").agg(
            total("_rows", 1).alias("total_sessions"), total("approved").alias("approved"),
            total("rejected").alias("rejected"), total("edited").alias("edited"))
    return rates.withColumn(
        "approval_rate", _percent(F.col("approved"), F.col("total_sessions"))) \
        .orderBy(F.desc("approval_rate"))


def rating_dist(t, days: int = 30, as_of=None) -> DataFrame:
    """Ratings with their share; the window runs over the few grouped rows."""
    counts = within(t["quality_feedback"], "created_at", as_of, days, closed=True) \
        .filter(F.col("human_rating").isNotNull()) \
        .groupBy("human_rating").agg(rows().alias("rating_count"))
    everything = F.sum("rating_count").over(Window.partitionBy())
    return counts.withColumn("percentage", _percent(F.col("rating_count"), everything)) \
                 .orderBy("human_rating")


def workflow_summary(t, days: int = 7, as_of=None) -> DataFrame:
    now = as_of_column(as_of, t["email_sessions"], STARTED)
    done = within(t["email_sessions"], COMPLETED, as_of, days, closed=True, as_of_from=STARTED) \
        .select(F.col("id").alias("_session"), hours_between(now, F.col(COMPLETED)).alias("_hours"))
    return t["email_workflows"].join(send_if_small(done), F.col("session_id") == F.col("_session")) \
        .groupBy("workflow_state").agg(rows().alias("session_count"),
                                       F.avg("_hours").alias("avg_hours_in_state")) \
        .orderBy(F.desc("session_count"))


def feedback_daily(t) -> DataFrame:
    acted = lambda a: F.count_if(F.col("human_action") == a).alias(f"{a}_count")
    return t["quality_feedback"].groupBy(F.to_date("created_at").alias("feedback_date")).agg(
        rows().alias("total_feedback"), F.avg("human_rating").alias("avg_rating"),
        acted("approved"), acted("edited"), acted("rejected"),
        F.avg("final_quality_score").alias("avg_quality_score")) \
        .orderBy(F.desc("feedback_date"))


def feedback_history(t, ids=None) -> DataFrame:
    """Feedback of each session, newest first."""
    kept = [c for c in ("human_action", "human_rating", "slack_user_name", "feedback_notes",
                        "created_at") if c in t["quality_feedback"].columns]
    return _pick(t["quality_feedback"], "session_id", _wanted(ids)).select("session_id", *kept) \
        .orderBy("session_id", F.desc_nulls_first("created_at"))


def latest_feedback(t, ids=None) -> DataFrame:
    """The newest action of each session; later id wins a tie."""
    newest = F.max_by(F.struct("human_action", "human_rating"), F.struct("created_at", "id"))
    return _pick(t["quality_feedback"], "session_id", _wanted(ids)).groupBy("session_id") \
        .agg(newest.alias("_last"), F.max("created_at").alias("created_at")) \
        .select("session_id", "_last.human_action", "_last.human_rating", "created_at")


def interaction_history(t, ids=None) -> DataFrame:
    """Clicks of each session, oldest first."""
    return _pick(t["slack_interactions"], "session_id", _wanted(ids)) \
        .select("session_id", "interaction_type", "action_value", "user_name", "created_at",
                "payload") \
        .orderBy("session_id", F.asc_nulls_last("created_at"))


CLICK_PAYLOAD = """
    type STRING, trigger_id STRING, user STRUCT<id: STRING, name: STRING>,
    channel STRUCT<id: STRING>, message STRUCT<ts: STRING>,
    actions ARRAY<STRUCT<action_id: STRING, type: STRING, value: STRING,
                         selected_option: STRUCT<value: STRING>>>"""


def _first_actions(col: str) -> Column:
    """List of the payload and its first action; empty when it has none."""
    opened = F.transform(F.array(F.from_json(F.col(col), CLICK_PAYLOAD)), lambda b: F.struct(
        b.alias("body"), F.get(b["actions"], F.lit(0)).alias("act")))
    return F.filter(opened, lambda p: p["act"].isNotNull())


def _rows_of(clicks: DataFrame, found: Column, *dropped: str) -> DataFrame:
    """Click columns with one row per entry of ``found``; the payload is parsed once."""
    return clicks.select(*[c for c in clicks.columns if c not in dropped], F.inline(found))


def parse_interactions(clicks: DataFrame, col: str = "payload") -> DataFrame:
    """One interaction row per click payload; payloads without action or session give none."""
    text = lambda c: F.coalesce(c, F.lit(""))

    def row(p):
        act, body = p["act"], p["body"]
        value = text(F.coalesce(act["value"], act["selected_option"]["value"]))
        return let(value, lambda v: F.struct(
            session_from_action(text(act["action_id"]), v).alias("session_id"),
            F.when(act["type"] == "button", "button_click").otherwise("selection")
             .alias("interaction_type"),
            before_underscore(v).alias("action_value"),
            text(body["user"]["id"]).alias("user_id"),
            text(body["user"]["name"]).alias("user_name"),
            text(body["channel"]["id"]).alias("channel_id"),
            text(body["message"]["ts"]).alias("message_ts"),
            text(body["trigger_id"]).alias("trigger_id")))

    found = F.filter(F.transform(_first_actions(col), row), lambda r: r["session_id"].isNotNull())
    return _rows_of(clicks, found, "session_id")


def feedback_from_clicks(clicks: DataFrame, col: str = "payload") -> DataFrame:
    """Feedback rows from clicks whose value is JSON: action, rating, score and edit class."""
    def read(p):
        act = p["act"]["action_id"]
        return F.struct(
            F.from_json(p["act"]["value"], "session_id STRING, rating INT").alias("value"),
            F.when(act.startswith("rate_"), "rated").when(act == "approve_draft", "approved")
             .when(act == "edit_draft", "edited").when(act == "reject_draft", "rejected")
             .alias("action"), p["body"]["user"].alias("user"))

    def row(c):
        rating = F.when(c["action"] == "rated", c["value"]["rating"]) \
            .when(c["action"] == "approved", APPROVAL_RATING) \
            .when(c["action"] == "rejected", REJECTION_RATING)
        distance = F.lit(0)
        return F.struct(
            c["value"]["session_id"].alias("session_id"), c["action"].alias("human_action"),
            rating.alias("human_rating"), distance.alias("edit_distance"),
            edit_type(distance).alias("edit_type"),
            quality_score(c["action"], rating, distance).alias("final_quality_score"),
            F.substring(c["value"]["session_id"], 1, 8).alias("slack_message_id"),
            c["user"]["id"].alias("slack_user_id"), c["user"]["name"].alias("slack_user_name"))

    kept = F.filter(F.transform(_first_actions(col), read), lambda c: c["action"].isNotNull()
                    & (F.coalesce(c["value"]["session_id"], F.lit("")) != ""))
    return _rows_of(clicks, F.transform(kept, row), col, "session_id")
