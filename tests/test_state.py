"""State of streams: it ends, and a poll works on its own rows, not on all history."""

import datetime as dt
import glob
import os

from conftest import rows
from pyspark.sql import functions as F

from reviewflow.operators import sessions as s
from reviewflow.operators import workflow as w
from reviewflow.schemas import schema
from reviewflow.session import scratch_dir
from reviewflow.sources.keyed import KeyedTable
from reviewflow.streaming import live
from reviewflow.streaming import sessions as ss
from reviewflow.streaming.runs import current, finish

DAY = dt.datetime(2024, 1, 1)


def polled(spark, polls, kinds):
    """A stream that hands out each list of rows as a poll."""
    path = scratch_dir(spark, "polled")
    for n, data in enumerate(polls):
        spark.createDataFrame(data, kinds).coalesce(1).write.parquet(f"{path}/part={n:03d}")
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


def size(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True))


def test_sessions_without_mail_are_forgotten(spark):
    at = lambda n: DAY + dt.timedelta(days=n)
    mail = lambda m, body, n: (m, body, "a", at(n))
    polls = [[mail("m1", "one", 0), mail("m2", "two", 0)], [mail("m3", "one", 2), mail("m4", "far", 3)],
             [mail("m5", "far", 8)], [mail("m6", "one", 9), mail("m7", "two", 9), mail("m8", "far", 9)]]
    stream = polled(spark, polls, "message_id STRING, body STRING, sender_email STRING, received_at TIMESTAMP")
    path = scratch_dir(spark, "forget")
    query = ss.session_state(stream, path, None, None, forget_days=4)
    finish(query)
    got = spark.read.parquet(f"{path}/rows").select("message_id", "decision")
    # Sessions one and two ended at days 6 and 4, the session "far" had mail at days 3 and 8.
    assert rows(got) == [("m1", "new"), ("m2", "new"), ("m3", "retry"), ("m4", "new"), ("m5", "retry"),
                         ("m6", "new"), ("m7", "new"), ("m8", "retry")]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6
    assert "rocksdb" in str(query.lastProgress["stateOperators"][0]["customMetrics"]).lower()
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or "")


def test_settled_actions_leave_the_log_and_older_ones_change_nothing(spark):
    kinds = "id LONG, session_id LONG, human_action STRING, created_at TIMESTAMP"
    at = lambda n: DAY + dt.timedelta(minutes=n)
    polls = [[(1, 1, "edited", at(1)), (2, 2, "approved", at(5)), (3, 3, "rated", at(6))],
             [(4, 1, "approved", at(9)), (5, 4, "rejected", at(2))],
             [(6, 1, "rejected", at(3)), (7, 2, "edited", at(5)), (8, 9, "approved", at(7))]]
    every = spark.createDataFrame([v for poll in polls for v in poll], kinds)
    flows = spark.range(40).select(F.col("id").alias("session_id"), F.lit("new").alias("workflow_state"),
                                   F.lit("start").alias("current_step"))
    want = rows(w.workflow_from_feedback(flows, every))
    path = scratch_dir(spark, "settle")
    finish(live.workflow_stream(polled(spark, polls, kinds), path, None))
    assert rows(live.live_workflows(spark, flows, path)) == want
    kept = flows.withColumn("acted_at", F.lit(None).cast("timestamp")).withColumn("acted_id", F.lit(None).cast("long"))
    table = KeyedTable.create(kept, f"{path}/kept", "session_id", 16)
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{table.path}/rows/*/*.parquet")}
    assert live.settle_workflows(table, path) == [0, 1]
    assert [os.path.basename(f) for f in glob.glob(f"{path}/actions/batch_id=*")] == ["batch_id=2"]
    now = rows(live.live_workflows(spark, table.read(), path).select(*flows.columns))
    assert now == want
    unchanged = [f for f, t in before.items() if os.path.exists(f) and os.stat(f).st_mtime_ns == t]
    assert len(unchanged) >= len(before) - 3
    assert live.settle_workflows(table, path) == []


def test_bytes_written_a_poll_do_not_grow_with_the_polls(spark):
    kinds = "id LONG, session_id LONG, human_action STRING, created_at TIMESTAMP"
    polls = [[(n * 50 + i, n * 50 + i, "approved", DAY + dt.timedelta(days=n)) for i in range(50)] for n in range(20)]
    path = scratch_dir(spark, "growth")
    finish(live.workflow_stream(polled(spark, polls, kinds), path, None))
    written = [size(f"{path}/actions/batch_id={n}") for n in range(20)]
    assert max(written) <= 1.2 * written[0]


def test_late_rows_rewrite_only_the_folder_of_their_closed_period(spark):
    kinds = "processing_started_at TIMESTAMP, status STRING"
    at = lambda day, minute=0: DAY + dt.timedelta(days=day, minutes=minute)
    polls = [[(at(n, m), "failed" if m == 3 else "completed") for m in range(0, 30, 3)] for n in range(12)]
    polls.append([(at(2, 3), "failed"), (None, "failed")])
    path = scratch_dir(spark, "late")
    finish(live.health_stream(polled(spark, polls, kinds), path, trigger=None))
    every = spark.createDataFrame([v for poll in polls for v in poll if v[0]], kinds)
    want = every.groupBy(F.window("processing_started_at", "5 minutes").start.alias("step")).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "failed").alias("errors"))
    assert rows(current(spark, path)) == rows(want)
    # Each day was written by its own poll, and day 2 once more by the late row.
    held = {tuple(f.split("/")[-2:]) for f in glob.glob(f"{path}/rows/batch_id=*/bucket=*")}
    first = (DAY - dt.datetime(1970, 1, 1)).days
    want = {(f"batch_id={n if n != 2 else 12}", f"bucket={(first + n) % 16}") for n in range(12)}
    assert held - want <= {("batch_id=2", f"bucket={(first + 2) % 16}")} and want <= held


def test_starts_are_given_up_after_the_limit_of_the_caller(spark):
    kinds = "session_id LONG, node_name STRING, run LONG, mark STRING, at TIMESTAMP, success BOOLEAN"
    at = lambda n: DAY + dt.timedelta(minutes=n)
    start = lambda k, n: (k, "n", 0, "start", at(n), None)
    end = lambda k, n: (k, "n", 0, "end", at(n), True)
    polls = [[start(1, 0), start(2, 1), end(9, 1)], [end(2, 20), start(3, 30)], [end(3, 31), end(1, 99), start(4, 99)]]
    for limit, found in ((None, [1, 2, 3]), ("25 minutes", [2, 3])):
        path = scratch_dir(spark, "limit")
        finish(live.node_duration_stream(polled(spark, polls, kinds), path, None, limit))
        got = live.streamed_durations(spark, path)
        assert sorted(r.session_id for r in got.collect()) == found
        every = spark.createDataFrame([v for poll in polls for v in poll], kinds)
        if limit is None:
            assert rows(got) == rows(s.node_durations(every))
        else:
            lost = spark.read.parquet(f"{path}/state").filter("kind = 'given_up'")
            assert [r.session_id for r in lost.collect()] == [1]


def test_late_events_are_counted_poll_by_poll(spark):
    kinds = "ts TIMESTAMP, seen TIMESTAMP"
    at = lambda n: DAY + dt.timedelta(minutes=n)
    polls = [[(at(0), at(1)), (at(0), at(6)), (at(9), at(0))], [(at(3), at(3))], [(at(1), at(60)), (None, at(1))]]
    path = scratch_dir(spark, "late-metrics")
    finish(live.drop_late_stream(polled(spark, polls, kinds), "ts", path, F.col("seen"), trigger=None))
    metrics = spark.read.parquet(f"{path}/metrics")
    got = {}
    for r in metrics.collect():
        got.setdefault(r.batch_id, {})[r.metric_name.rsplit("_", 1)[1]] = r.metric_value
    assert got == {0: {"read": 3, "kept": 1, "dropped": 2}, 1: {"read": 1, "kept": 1, "dropped": 0},
                   2: {"read": 2, "kept": 0, "dropped": 2}}
    assert spark.read.parquet(f"{path}/rows").count() == 2
    assert set(metrics.columns) == {*schema("system_metrics").fieldNames(), "batch_id"}
