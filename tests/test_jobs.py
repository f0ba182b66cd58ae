"""Joins under skew, state folds, sinks, streams."""

import datetime as dt

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from reviewflow.functions.period import within
from reviewflow.functions.ranking import number_in_group
from reviewflow.operators import crm
from reviewflow.operators import dashboard as d
from reviewflow.operators import ingest as g
from reviewflow.operators import prompts as p
from reviewflow.operators import quality as q
from reviewflow.operators import retrieval as rv
from reviewflow.operators import review as r
from reviewflow.operators import sessions as s
from reviewflow.operators import vector_index as vi
from reviewflow.operators import workflow as w
from reviewflow.operators.joins import left_join_many
from reviewflow.schemas import LOG_SCHEMAS, schema
from reviewflow.session import scratch_dir
from reviewflow.sources import logs
from reviewflow.streaming import ingest as si
from reviewflow.streaming import live
from reviewflow.streaming import sessions as ss
from reviewflow.streaming.runs import current, finish

DAY = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("hot_rows", [1, 3, 7, 1000])
def test_left_join_many_equals_left_join(spark, hot_rows):
    left = spark.createDataFrame([(i, f"n{i}") for i in range(6)] + [(None, "none")],
                                 "id INT, name STRING")
    many = [(1, i) for i in range(40)] + [(2, 1), (2, 1), (3, 5), (9, 9), (None, 1)]
    right = spark.createDataFrame(many, "session_id INT, v INT")
    got = left_join_many(left, right, "id", "session_id", hot_rows)
    want = left.join(right, F.col("id") == F.col("session_id"), "left").drop("session_id")
    assert rows(got) == rows(want)
    both = left.unionByName(left)
    got = left_join_many(both, right, "id", "session_id", hot_rows)
    want = both.join(right, F.col("id") == F.col("session_id"), "left").drop("session_id")
    assert rows(got) == rows(want)


def test_a_hot_key_of_equal_rows_is_spread_evenly(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "id INT, name STRING")
    right = spark.range(0, 1_000_000, 1, 8).select(F.lit(1).alias("session_id"),
                                                   (F.col("id") % 2).cast("string").alias("action"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        joined = left_join_many(left, right, "id", "session_id", 10_000)
        sizes = [v[1] for v in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 1_000_001 and len(sizes) > 40
        # A task may hold several of the hundred parts, each a hundredth of the rows.
        assert max(sizes) <= 6 * 10_000 + 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hot_by_bytes(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "id INT")
    right = spark.createDataFrame([(1, "x" * 400)] * 9 + [(2, None)], "session_id INT, draft STRING")
    got = left_join_many(left, right, "id", "session_id", part_bytes=1000)
    want = left.join(right, F.col("id") == F.col("session_id"), "left").drop("session_id")
    assert rows(got) == rows(want)


@pytest.mark.parametrize("hot_rows", [1, 2])
def test_session_summary_under_skew(spark, t, hot_rows):
    assert rows(s.session_summary(t, hot_rows=hot_rows)) == rows(s.session_summary(t))


def test_fan_out_is_the_product(t):
    n = lambda name: dict(t[name].groupBy("session_id").count().collect())
    f, e, dr = n("quality_feedback"), n("document_extractions"), n("draft_generations")
    got = dict(s.session_summary(t).groupBy("id").count().collect())
    for key, count in got.items():
        assert count == max(f.get(key, 0), 1) * max(e.get(key, 0), 1) * max(dr.get(key, 0), 1)
    assert s.session_summary(t, one_row_per_session=True).count() == len(got)


def test_ids_as_list_and_frame(spark, t):
    ids = [1, 2, 3]
    frame = spark.createDataFrame([(i,) for i in ids], "id BIGINT")
    assert rows(s.session_detail(t, ids)) == rows(s.session_detail(t, frame))
    assert rows(s.session_detail(t, ids)) == rows(s.session_detail(t).filter(F.col("id").isin(ids)))


def test_recent_sessions_equals_plain_join(t):
    got = s.recent_sessions(t, 20)
    assert got.count() == 20
    newest = t["email_sessions"].orderBy(F.desc("processing_started_at"), "id").limit(20)
    assert set(v.id for v in got.collect()) <= set(v.id for v in newest.collect())


def test_anti_and_semi_make_all(t):
    sessions, feedback = t["email_sessions"], t["quality_feedback"]
    on = sessions["id"] == feedback["session_id"]
    parts = [sessions.join(feedback, on, how).count() for how in ("left_semi", "left_anti")]
    assert sum(parts) == sessions.count()


@pytest.mark.parametrize("run", [1, 3, 10, 1000])
def test_number_in_group(spark, run):
    data = [("a", i) for i in range(0, 50, 2)] + [("b", 7), (None, 1), (None, 9)]
    got = number_in_group(spark.createDataFrame(data, "g STRING, id INT"), ["g"], "id", "n", run)
    seen = {}
    for group, _, n in sorted(rows(got), key=lambda v: (str(v[0]), v[1])):
        seen.setdefault(group, []).append(n)
    assert seen == {"a": list(range(1, 26)), "b": [1], None: [1, 2]}


def test_number_in_group_by_text_and_sparse_ids(spark):
    keys = [f"{(i * 7919) % 1000:03d}-{i:05d}" for i in range(300)] + ["", "\u00e9", "000-00000-later"]
    df = spark.createDataFrame([("a", k) for k in keys] + [("b", "x")], "g STRING, id STRING")
    got = {v.id: v.n for v in number_in_group(df, ["g"], "id", "n", 20).filter("g = 'a'").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda v: v[1])] == sorted(keys, key=str.encode)
    far = spark.createDataFrame([("a", i * (1 << 50)) for i in range(-40, 40)], "g STRING, id BIGINT")
    got = {v.id: v.n for v in number_in_group(far, ["g"], "id", "n", 10).collect()}
    assert [got[i * (1 << 50)] for i in range(-40, 40)] == list(range(1, 81))


def test_versions_by_text_id(spark):
    kinds = "id STRING, prompt_name STRING, version INT"
    old = spark.createDataFrame([("x", "a", 3), ("y", "a", 1)], kinds)
    new = spark.createDataFrame([("k2", "a"), ("k10", "a"), ("k1", "b")], "id STRING, prompt_name STRING")
    assert rows(p.assign_versions(old, new).select("id", "version")) == [("k1", 1), ("k10", 4), ("k2", 5)]
    assert p.assign_versions(old, new.limit(0)).count() == 0


@pytest.mark.parametrize("sent,block", [(1000, 64), (40, 64), (7, 64), (1, 64), (0, 64), (0, 7), (0, 1000)])
def test_top_k_against_brute_force(spark, sent, block):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 8)).astype("f4")
    vectors[20:40] = vectors[5]
    data = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(data, "vec_id BIGINT, embedding ARRAY<FLOAT>").repartition(5)
    unit = vectors.astype("f8") / np.linalg.norm(vectors.astype("f8"), axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 9)
    want = []
    for i in range(60):
        order = sorted((j for j in range(60) if j != i), key=lambda j: (-sims[i, j], j))[:4]
        want += [(i, j, n + 1) for n, j in enumerate(order)]
    df = df.unionByName(spark.createDataFrame([(99, None), (98, [0.0] * 8)], df.schema))
    got = rv.top_k_threads(df, df, 4, skip_self=True, broadcast_rows=sent, block=block)
    assert rows(got.select("query_id", "vec_id", "rank")) == sorted(want, key=repr)


def test_match_client_examples(spark):
    folders = spark.createDataFrame([(1, "Crm Works - Jo Varga"), (2, "Ringfield"), (3, "Jo")],
                                    "folder_id INT, name STRING")
    mails = spark.createDataFrame([("a", "Jo Varga sounds great"), ("b", "about RINGFIELD."),
                                   ("c", "hello"), ("d", None)], "message_id STRING, body STRING")
    assert rows(rv.match_client(mails, folders).select("message_id", "client_folder_id")) == [
        ("a", 1), ("b", 2), ("c", None), ("d", None)]
    none = rv.match_client(mails, folders.limit(0))
    assert none.filter("client_matched").count() == 0 and none.count() == 4


def test_pick_document(spark):
    docs = spark.createDataFrame(
        [(1, "f", "Final Brief v1"), (2, "f", "Final Brief v3"), (3, "f", "Bio v9"),
         (4, "g", "Bio"), (5, "g", "Angles v2"), (6, "g", "Notes v7")],
        "document_id INT, folder_id STRING, name STRING")
    mails = spark.createDataFrame(
        [("a", "f", "send a bio"), ("b", "g", "send a bio"), ("c", "g", "which Angles"),
         ("d", "g", "hi"), ("e", None, "hi"), ("h", "z", "hi")],
        "message_id STRING, client_folder_id STRING, body STRING")
    got = rv.pick_document(docs, mails).select("message_id", "selected_document_id",
                                               "documents_found", "extraction_status")
    assert rows(got) == [
        ("a", 2, 3, "Success"), ("b", 4, 3, "Success"), ("c", 5, 3, "Success"),
        ("d", 6, 3, "Success"), ("e", None, 0, "No matching client folder found"),
        ("h", None, 0, "No documents found in the client folder")]


def test_admit(spark):
    mails = spark.createDataFrame(
        [("m1", "new", "a", DAY), ("m2", "done", "a", DAY), ("m3", "failed", "a", DAY),
         ("m4", "open", "a", DAY), ("m6", "twice", "a", DAY + dt.timedelta(hours=1)),
         ("m5", "twice", "a", DAY)],
        "message_id STRING, body STRING, sender_email STRING, received_at TIMESTAMP")
    from reviewflow.functions.text import email_hash

    known = spark.createDataFrame([("s2", "done", "completed"), ("s3", "failed", "failed"),
                                   ("s4", "open", "processing")], "id STRING, b STRING, status STRING") \
        .withColumn("email_hash", email_hash(F.col("b"), F.lit("a")))
    got = g.admit(mails, known).select("message_id", "decision", "session_id", "status", "copies")
    assert rows(got) == [("m1", "new", None, "processing", 1), ("m2", "skip", "s2", "completed", 1),
                         ("m3", "retry", "s3", "processing", 1),
                         ("m4", "retry", "s4", "processing", 1),
                         ("m5", "new", None, "processing", 2)]


def feedback(spark, data):
    return spark.createDataFrame(
        [(i, a, b, DAY + dt.timedelta(minutes=m)) for i, (a, b, m) in enumerate(data)],
        "id INT, session_id STRING, human_action STRING, created_at TIMESTAMP")


def test_workflow_from_feedback(spark):
    wf = spark.createDataFrame([(x, "start", "step") for x in "abcd"],
                               "session_id STRING, workflow_state STRING, current_step STRING")
    fb = feedback(spark, [("a", "approved", 1), ("b", "edited", 1), ("b", "rejected", 2),
                          ("c", "rated", 1), ("a", "rated", 5)])
    assert rows(w.workflow_from_feedback(wf, fb)) == [
        ("a", "approved", "ready_to_send"), ("b", "rejected", "rejected"), ("c", "start", "step"),
        ("d", "start", "step")]


def test_workflow_from_clicks(spark):
    wf = spark.createDataFrame([(x, "start", "step") for x in "abc"],
                               "session_id STRING, workflow_state STRING, current_step STRING")
    clicks = feedback(spark, [("a", "approve", 1), ("b", "rate_5", 2), ("c", "feedback", 1)]) \
        .withColumnRenamed("human_action", "action_value")
    assert [v[:3] for v in rows(w.workflow_from_clicks(wf, clicks))] == [
        ("a", "approved", "creating_gmail_draft"), ("b", "rated", "awaiting_action"),
        ("c", "start", "step")]


def test_one_active_version_after_activation(spark, t):
    names = [v.prompt_name for v in t["prompt_templates"].collect()]
    picked = spark.createDataFrame([(n, 2 if n != "Brand#1" else 99) for n in names],
                                   "prompt_name STRING, version INT")
    after = p.activate(t["prompt_versions"], picked)
    active = {v.prompt_name: v.version for v in after.filter(
        "is_active AND prompt_name <> 'Brand#1'").collect()}
    assert active == {n: 2 for n in names if n != "Brand#1"}
    same = lambda df: rows(df.filter("prompt_name = 'Brand#1'").select("id", "is_active"))
    assert same(after) == same(t["prompt_versions"])
    missing = spark.createDataFrame([("Brand#1", -1)], "prompt_name STRING, version_id BIGINT")
    assert same(p.activate(t["prompt_versions"], missing).filter("is_active")) == []


def test_seed_twice_changes_nothing(spark):
    t0 = {"prompt_templates": spark.createDataFrame([("a", "c")], "prompt_name STRING, category STRING"),
          "prompt_versions": spark.createDataFrame(
              [("a", 1, "old", False), ("a", 2, "newer", False)],
              "prompt_name STRING, version INT, content STRING, is_active BOOLEAN")}
    defaults = spark.createDataFrame([("a", "da", "c"), ("b", "db", "c")],
                                     "prompt_name STRING, content STRING, category STRING")
    templates, versions = p.seed_prompts(t0, defaults)
    assert rows(templates) == [("a", "c"), ("b", "c")]
    assert rows(versions.filter("is_active").select("prompt_name", "version", "content")) == [
        ("a", 3, "da"), ("b", 1, "db")]
    assert versions.groupBy("prompt_name", "version").count().filter("count > 1").count() == 0
    again = p.seed_prompts({"prompt_templates": templates, "prompt_versions": versions}, defaults)
    assert rows(again[0]) == rows(templates) and rows(again[1]) == rows(versions)


def test_latest_active_of_several(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 3, True), ("a", 9, False), ("b", 1, False)],
                               "prompt_name STRING, version INT, is_active BOOLEAN")
    assert rows(p.latest_active(df)) == [("a", 3, True)]


def test_variant_share(spark):
    share = p.assign_variants(spark.range(20000), 0.3).filter("variant = 'a'").count() / 20000
    assert abs(share - 0.3) < 0.02


def test_window_edges(spark):
    df = spark.createDataFrame([(DAY,), (DAY + dt.timedelta(days=7),)], "ts TIMESTAMP")
    assert within(df, "ts", None, 7).count() == 1
    assert within(df, "ts", None, 7, closed=True).count() == 2
    assert within(df, "ts", DAY + dt.timedelta(days=1), 7).count() == 2


def test_empty_tables(spark):
    t0 = {n: spark.createDataFrame([], schema(n)) for n in LOG_SCHEMAS}
    assert rows(d.overview(t0)) == [(0, 0.0, 0.0, "Last 7 days")]
    assert rows(d.system_health(t0)) == [(0.0, 0, 0)]
    assert d.timeline_summary(t0).count() == 0
    assert rows(d.extraction_stats(t0).select("total_attempts", "success_rate")) == [(0, 0.0)]
    assert s.session_summary(t0).count() == 0 and r.approval_rates(t0).count() == 0
    assert "auto_quality_score" in s.session_summary(t0).columns
    assert q.check_ranges(t0).filter("violations > 0").count() == 0


def test_descending_nulls_first(spark):
    df = spark.createDataFrame([("a", None), ("b", 5)], "node_name STRING, duration_ms INT")
    t0 = {"node_executions": df.withColumn("session_id", F.lit("s")).withColumn("success", F.lit(True)),
          "email_sessions": spark.createDataFrame([("s", DAY)], "id STRING, processing_started_at TIMESTAMP")}
    assert [v.node_name for v in d.node_stats(t0).collect()] == ["a", "b"]


def test_retention_and_archive(spark):
    old = spark.createDataFrame([(DAY,), (DAY + dt.timedelta(days=90),), (DAY - dt.timedelta(days=1),),
                                 (None,)], "created_at TIMESTAMP")
    assert w.drop_old(old).count() == 3
    sessions = spark.createDataFrame(
        [(dt.datetime(2024, 8, 31), dt.datetime(2024, 2, 28), "completed"),
         (dt.datetime(2024, 8, 31), dt.datetime(2024, 2, 29), "completed"),
         (dt.datetime(2024, 8, 31), dt.datetime(2024, 2, 1), "failed")],
        "processing_started_at TIMESTAMP, processing_completed_at TIMESTAMP, status STRING")
    assert [v.status for v in w.archive(sessions).collect()] == ["archived", "completed", "failed"]


def test_node_durations_need_both_marks(spark):
    at = lambda n: DAY + dt.timedelta(seconds=n)
    marks = spark.createDataFrame(
        [("s", "n", 1, "start", at(0), None), ("s", "n", 1, "end", at(2), True),
         ("s", "n", 2, "end", at(2), True), ("s", "n", 3, "start", at(2), None)],
        "session_id STRING, node_name STRING, run INT, mark STRING, at TIMESTAMP, success BOOLEAN")
    assert rows(s.node_durations(marks).select("run", "duration_ms", "success")) == [(1, 2000, True)]
    again = spark.createDataFrame(
        [("s", "n", 1, m, at(n), ok) for m, n, ok in [
            ("start", 0, None), ("end", 5, True), ("start", 9, None), ("start", 20, None), ("end", 21, False),
            ("end", 22, True), ("start", 30, None), ("end", 30, True)]], marks.schema)
    assert rows(s.node_durations(again).select("duration_ms", "success")) == [
        (0, True), (1000, False), (5000, True)]


def test_crm(spark):
    df = spark.createDataFrame([("a", ["X", "Y"], "Big"), ("b", ["x"], "small"), ("c", None, None)],
                               "id STRING, options ARRAY<STRING>, size STRING")
    upd = spark.createDataFrame([("a", ["Y", "Z"]), ("c", ["Z"])], "id STRING, options ARRAY<STRING>")
    got = lambda over: [v[1] for v in rows(crm.crm_update(df, upd, over))]
    assert got(False) == [["X", "Y", "Z"], ["x"], ["Z"]]
    assert got(True) == [["Y", "Z"], ["x"], ["Z"]]
    ids = lambda *a: [v.id for v in crm.crm_filter(df, *a).collect()]
    assert ids("options", "X") == ["a", "b"] and ids("options", ["x", "y"]) == ["a"]
    assert ids("size", ["BIG"]) == ["a"] and ids("size", ["a", "b"]) == []
    assert [v.id for v in crm.page(df, ["id"], 2, 2).collect()] == ["c"]


def test_log_round_trip(spark):
    path = scratch_dir(spark, "log-test")
    rows_in = spark.createDataFrame(
        [("1", "s", "approved", DAY), ("2", "s", "rated", DAY + dt.timedelta(days=1))],
        "id STRING, session_id STRING, human_action STRING, created_at TIMESTAMP")
    logs.append_log(rows_in, path, "quality_feedback")
    logs.append_log(rows_in.limit(0), path, "quality_feedback")
    back = logs.load_tables(spark, path, ["quality_feedback"])["quality_feedback"]
    assert rows(back.select("id", "human_action", "day")) == [
        ("1", "approved", DAY.date()), ("2", "rated", DAY.date() + dt.timedelta(days=1))]
    assert "PartitionFilters: [isnotnull(day" in \
        back.filter("day = '2024-01-02'")._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        logs.append_log(rows_in.withColumn("extra", F.lit(1)), path, "quality_feedback")


def test_bucketed_logs_join_without_shuffle(spark, t):
    stamp = scratch_dir(spark, "b")[-12:]
    left = logs.write_bucketed(t["email_workflows"], f"workflows_{stamp}", 4)
    right = logs.write_bucketed(t["quality_feedback"], f"feedback_{stamp}", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = left.join(right, "session_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        plain = t["email_workflows"].join(t["quality_feedback"], "session_id")
        assert joined.count() == plain.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for table in ("workflows", "feedback"):
            spark.sql(f"DROP TABLE {table}_{stamp}")


def test_period_facts_are_not_shuffled(spark, t):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = s.in_period(t["node_executions"], t["email_sessions"]) \
            ._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_window_start_reaches_the_scan(t, capsys):
    d.label_counts(t).explain("formatted")
    assert "GreaterThan(o_orderdate,ScalarSubquery" in capsys.readouterr().out


def test_shuffle_size(spark):
    from reviewflow.session import configure

    before = spark.conf.get("spark.sql.shuffle.partitions")
    configure(spark, shuffled_bytes=10**14)
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) == -(-10**14 // (128 * 1024**2))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def in_files(df, path, by, parts=3):
    """Write ``df`` in ``parts`` files that arrive in the order of ``by``."""
    data = df.orderBy(by).collect()
    for n in range(parts):
        piece = data[n * len(data) // parts:(n + 1) * len(data) // parts]
        df.sparkSession.createDataFrame(piece, df.schema).coalesce(1) \
            .write.parquet(f"{path}/part={n}")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1) \
        .parquet(f"{path}/part=*")


def test_workflow_stream_equals_batch(spark, t):
    fb = t["quality_feedback"].withColumn("created_at", F.col("created_at").cast("timestamp"))
    path = scratch_dir(spark, "wf-test")
    finish(live.workflow_stream(in_files(fb, f"{path}/in", "created_at"), f"{path}/out", None))
    assert rows(live.live_workflows(spark, t["email_workflows"], f"{path}/out")) == \
        rows(w.workflow_from_feedback(t["email_workflows"], t["quality_feedback"]))


def test_feedback_stream_in_polls_equals_one_poll(spark, t):
    fb = t["quality_feedback"].withColumn("created_at", F.col("created_at").cast("timestamp"))
    path = scratch_dir(spark, "fb-test")
    finish(live.feedback_stream(in_files(fb, f"{path}/in", "created_at"), f"{path}/out", None))
    got = live.feedback_days(current(spark, f"{path}/out"))
    want = r.feedback_daily(t)
    assert rows(got.drop("avg_quality_score")) == rows(want.drop("avg_quality_score"))


def test_duration_stream_equals_batch_over_polls(spark, t):
    from reviewflow.plans.review import node_marks

    marks = node_marks(t).withColumn("at", F.col("at").cast("timestamp"))
    path = scratch_dir(spark, "marks-test")
    finish(live.node_duration_stream(in_files(marks, f"{path}/in", "at", 5), f"{path}/out", None))
    got = live.streamed_durations(spark, f"{path}/out")
    want = s.node_durations(marks)
    assert rows(got) == rows(want) and want.filter("duration_ms > 3600000").count() > 0


def test_wrong_vectors_and_late_counts(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0]), (4, None)],
                               "vec_id BIGINT, embedding ARRAY<FLOAT>")
    got = rv.top_k_threads(df, df, 1, skip_self=True)
    assert rows(got.select("query_id", "vec_id")) == [(1, 2), (2, 1)]
    good, bad = rv.valid_threads(df.withColumnRenamed("embedding", "$vector"), ("vec_id", "$vector"), 2)
    assert rows(good.select("vec_id")) == [(1,), (2,)]
    assert rows(bad.select("vec_id", F.array_join("missing", ","))) == [(3, "$vector"), (4, "$vector")]
    events = spark.createDataFrame([(DAY, DAY), (DAY, DAY + dt.timedelta(hours=9))], "ts TIMESTAMP, seen TIMESTAMP")
    assert rows(live.late_counts(events, "ts", F.col("seen"))) == [(DAY, 2, 1)]


RAW = "message_id STRING, subject STRING, senders ARRAY<STRUCT<email: STRING, name: STRING>>, " \
      "body STRING, snippet STRING, received_at TIMESTAMP"


def feed(spark, path, polls):
    for n, mails in enumerate(polls):
        data = [(m, sub, [("a@x", "A")], body, None, DAY + dt.timedelta(minutes=n))
                for m, sub, body in mails]
        spark.createDataFrame(data, RAW).coalesce(1).write.json(f"{path}/part={n}")
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).json(f"{path}/part=*")


def test_ingest_retries_until_completed(spark):
    path = scratch_dir(spark, "ingest-test")
    polls = [[("m1", "good", "one"), ("m2", "bad", "two"), ("m3", "good", "whale-floor")],
             [("m4", "good", "one"), ("m5", "bad", "two")],
             [("m6", "bad", "two"), ("m7", "bad", "two")]]

    def process(mails):
        return mails.select("session_id", F.lit("Accepted").alias("label"), F.when(
            F.col("subject") == "bad", "broken").alias("error"))

    finish(si.run_ingest(feed(spark, f"{path}/in", polls), f"{path}/out", process, trigger=None))
    log = si.session_log(spark, f"{path}/out")
    assert rows(log.filter("step = 0").select("batch_id", "message_id", "decision")) == [
        (0, "m1", "new"), (0, "m2", "new"), (1, "m5", "retry"), (2, "m6", "retry")]
    now = si.current_sessions(spark, f"{path}/out")
    assert rows(now.select("subject", "status", "classification")) == [
        ("bad", "failed", "Accepted"), ("good", "completed", "Accepted")]
    si.compact_sessions(spark, f"{path}/out", f"{path}/next")
    assert rows(si.current_sessions(spark, f"{path}/next").drop("batch_id", "step")) == \
        rows(now.drop("batch_id", "step"))


def test_session_state_over_polls(spark):
    from reviewflow.functions.text import email_hash

    kinds = "message_id STRING, body STRING, sender_email STRING, received_at TIMESTAMP, " \
            "closed_as STRING"
    at = lambda n: DAY + dt.timedelta(minutes=n)
    polls = [[("m1", "one", "a", at(0), None), ("m0", "one", "a", at(1), None),
              (None, "one", "a", at(2), "completed"), (None, "two", "a", at(2), "failed")],
             [("m2", "one", "a", at(10), None), ("m3", "two", "a", at(10), None)],
             [(None, "two", "a", at(20), "failed"), ("m4", "two", "a", at(21), None)]]
    path = scratch_dir(spark, "state-test")
    for n, data in enumerate(polls):
        spark.createDataFrame(data, kinds).coalesce(1).write.parquet(f"{path}/in/part={n}")

    def stream():
        return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1) \
                    .parquet(f"{path}/in/part=*")

    closes = stream().filter("closed_as IS NOT NULL").select(
        email_hash(F.col("body"), F.col("sender_email")).alias("email_hash"), "closed_as",
        "received_at")
    finish(ss.session_state(stream().filter("closed_as IS NULL"), f"{path}/out", closes, None))
    got = spark.read.parquet(f"{path}/out/rows").select("message_id", "decision", "copies", "status")
    assert rows(got) == [("m1", "new", 2, "processing"), ("m2", "skip", 1, "completed"),
                         ("m3", "new", 1, "processing"), ("m4", "retry", 1, "processing")]


def test_deep_page_and_seek(spark):
    df = spark.range(0, 50_000).select((F.col("id") * 7919 % 50_000).alias("k"), F.col("id").alias("i"))
    df = df.unionByName(spark.createDataFrame([(None, -1), (None, -2)], df.schema))
    for number in (1, 3, 300, 500, 501):
        want = df.orderBy("k", "i").offset((number - 1) * 100).limit(100)
        assert [tuple(v) for v in crm.page(df, ["k", "i"], number, 100).collect()] == \
            [tuple(v) for v in want.collect()]
    texts = df.select(F.when(F.col("i") % 3 == 0, "hot").otherwise(F.format_string("begin-%06d", "k")).alias("k"), "i")
    for number in (150, 400, 500, 501):
        want = texts.orderBy("k", "i").offset((number - 1) * 100).limit(100)
        assert [tuple(v) for v in crm.page(texts, ["k", "i"], number, 100).collect()] == \
            [tuple(v) for v in want.collect()]
    known = df.filter("k IS NOT NULL")
    first = crm.page_after(known, ["k", "i"], None, 10).collect()
    second = crm.page_after(known, ["k", "i"], list(first[-1]), 10).collect()
    assert [v.k for v in first + second] == list(range(20))


def test_period_queries_read_only_their_days(spark):
    path = scratch_dir(spark, "days-test")
    made = [(str(n), "s", DAY + dt.timedelta(days=n)) for n in range(100)]
    logs.append_log(spark.createDataFrame(made, "id STRING, session_id STRING, created_at TIMESTAMP"), path,
                    "quality_feedback")
    log = logs.load_tables(spark, path, ["quality_feedback"])["quality_feedback"]
    for cut, n in ((within(log, "created_at", None, 7), 7), (within(log, "created_at", DAY, 7, closed=True), 100),
                   (w.drop_old(log, DAY + dt.timedelta(days=99), 9), 10)):
        assert cut.count() == n
        plan = cut._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan.split("Subquery")[0]


def test_scan_of_a_text_with_very_many_matches(spark):
    from reviewflow.operators.scan import scan_patterns

    df = spark.createDataFrame([(1, "x\n" * 100_000), (1, "\n\nx x\nx")], "doc_id INT, text STRING")
    got = scan_patterns(df, {"x": "x"})
    assert got.count() == 100_003 and got.agg(F.max("line")).first()[0] == 100_000
    few = scan_patterns(df.filter("length(text) < 10"), {"x": "x", "gap": "\\n+"})
    assert rows(few.select("type", "line", "match")) == [
        ("gap", 1, "\n\n"), ("gap", 3, "\n"), ("x", 3, "x"), ("x", 3, "x"), ("x", 4, "x")]


def test_configured_variants_take_the_test_started_last(spark):
    at = lambda n: DAY + dt.timedelta(hours=n)
    configs = spark.createDataFrame([
        (1, "p", "a1", "b1", 0.5, True, at(0), at(200)), (2, "p", "a2", "b2", 0.0, True, at(50), at(60)),
        (3, "p", "a3", "b3", 1.0, True, at(50), at(55)), (4, "p", "a4", "b4", 1.0, False, at(52), None),
        (5, "q", "a5", "b5", 1.0, True, at(0), None), (6, "q", "a6", "b6", 1.0, True, at(90), at(80)),
        (7, "r", "a7", "b7", 1.0, True, None, None)],
        "id LONG, prompt_name STRING, variant_a_version_id STRING, variant_b_version_id STRING, "
        "traffic_split DOUBLE, is_active BOOLEAN, start_date TIMESTAMP, end_date TIMESTAMP")
    uses = [(s_, n, at(h)) for s_, (n, h) in enumerate([
        ("p", -1), ("p", 49), ("p", 50), ("p", 57), ("p", 60), ("p", 200), ("q", 1000), ("r", 3), (None, 3)])]
    uses.append((99, "p", None))
    df = spark.createDataFrame(uses, "session_id LONG, prompt_name STRING, created_at TIMESTAMP")
    got = {v.session_id: (v.test_id, v.variant, v.version_id) for v in p.assign_configured(df, configs).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: None, 1: 1, 2: 2, 3: 2, 4: 1, 5: None, 6: 5, 7: None, 8: None,
                                                 99: None}
    assert got[2] == (2, "b", "b2") and got[6] == (5, "a", "a5") and got[0] == (None, None, None)
    many = spark.range(4000).select(F.col("id").alias("session_id"), F.lit("p").alias("prompt_name"),
                                    F.lit(at(1)).alias("created_at"))
    share = p.assign_configured(many, configs).filter("variant = 'a' AND version_id = 'a1'").count() / 4000
    assert abs(share - 0.5) < 0.04


def test_configured_tests_of_any_times_and_number(spark):
    rng = np.random.default_rng(5)
    hours = [0, 0, 6, 18, 23.5]
    at = lambda: DAY + dt.timedelta(days=int(rng.integers(-3, 40)), hours=float(rng.choice(hours)))
    long = [0, 1, 12, 24, 36, 700, 4000]
    configs = []
    for i in range(400):
        start = at()
        end = None if i % 9 == 0 else start + dt.timedelta(hours=int(rng.choice(long)))
        configs.append((int(rng.integers(0, 300)), f"p{i % 3}", "a", "b", 1.0, i % 5 > 0, start, end))
    uses = [(i, f"p{rng.integers(0, 4)}", at() + dt.timedelta(microseconds=int(rng.integers(-1, 2)))) for i in range(600)]
    df = spark.createDataFrame(uses, "session_id LONG, prompt_name STRING, created_at TIMESTAMP")
    kind = ("id LONG, prompt_name STRING, variant_a_version_id STRING, variant_b_version_id STRING, traffic_split DOUBLE, "
            "is_active BOOLEAN, start_date TIMESTAMP, end_date TIMESTAMP")
    got = {v.session_id: v.test_id for v in p.assign_configured(df, spark.createDataFrame(configs, kind)).collect()}
    for session, name, time in uses:
        runs = [(-c[6].timestamp(), c[0]) for c in configs if c[1] == name and c[5] and c[6] <= time
                and (c[7] is None or time < c[7])]
        assert got[session] == (min(runs)[1] if runs else None)
    assert sum(x is not None for x in got.values()) > 300 and len(got) == len(uses)
    none = p.assign_configured(df.limit(0), spark.createDataFrame(configs, kind))
    assert none.count() == 0

    # However many tests run on a day, it holds only those that win at some time.
    many = spark.range(3000).select(
        "id", F.lit("p").alias("prompt_name"), F.lit("a").alias("variant_a_version_id"),
        F.lit("b").alias("variant_b_version_id"), F.lit(0.5).alias("traffic_split"), F.lit(True).alias("is_active"),
        (F.lit(DAY) + F.make_dt_interval((F.col("id") % 30).cast("int"), F.lit(6))).alias("start_date"),
        F.lit(None).cast("timestamp").alias("end_date"))
    won = p.winning_tests(many, DAY.date(), DAY.date() + dt.timedelta(days=99)).collect()
    assert len(won) == 30 + 29 + 70 and {x.test_id for x in won} == set(range(30))


def test_rough_products_leave_few_pairs_to_work_out():
    rng = np.random.default_rng(4)
    units = rng.normal(size=(4000, 16))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    sims = (units[:50] @ units.T).astype(np.float32)
    floor = rv._kth(sims, 5)
    assert (floor <= np.sort(sims, axis=1)[:, -5]).all() and (sims >= floor[:, None]).sum() < 50 * 8
    # Copies, threads without a direction and the queries themselves.
    units[3000:], units[7] = units[:1000], np.nan
    ids = np.arange(4000) % 3500
    got = {}
    for q, i, value in zip(*rv._best(ids[:50], units[:50], ids, units, 5, True)):
        got.setdefault(q, []).append((-value, i))
    whole = np.round(units[:50] @ units.T, 9)
    for q in range(50):
        want = sorted((-whole[q, j], ids[j]) for j in range(4000) if ids[j] != q and np.isfinite(whole[q, j]))[:5]
        assert got.get(q, []) == want


@pytest.mark.parametrize("probes", [4, 20])
def test_index_search_sends_a_query_once_to_a_part(spark, monkeypatch, probes):
    rng = np.random.default_rng(6)
    units = rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(units)], "vec_id LONG, embedding ARRAY<FLOAT>")
    path = scratch_dir(spark, "index")
    vi.build_index(df, path, 20)
    monkeypatch.setattr(vi, "PART_ROWS", 100)
    monkeypatch.setattr(vi, "QUERY_ROWS", 150)
    plain = vi.search_index(df, path, 3, probes, skip_self=True).collect()
    units = rv._unit(units.astype("f4"))
    centers = np.stack(spark.read.parquet(f"{path}/centroids").orderBy("list").toPandas()["center"])
    held = spark.read.parquet(f"{path}/lists").toPandas()
    own = dict(zip(held["vec_id"], held["list"]))
    want = set()
    for q in range(600):
        near = set(np.argsort(-(units[q] @ centers.T), kind="stable")[:probes].tolist())
        best = sorted((-round(float(units[q] @ units[j]), 9), j) for j in range(600) if j != q and own[j] in near)[:3]
        want |= {(q, j, n + 1) for n, (_, j) in enumerate(best)}
    assert {(x.query_id, x.vec_id, x["rank"]) for x in plain} == want
    # What is shuffled after the search: three rows for a query and part, not for a query and list.
    monkeypatch.setattr(vi, "_top", lambda found, *_: found)
    assert vi.search_index(df, path, 3, probes, skip_self=True).count() <= 600 * 3 * 6


def test_many_removed_sessions_are_dealt_to_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(w, "TASK_ROWS", 100)
    monkeypatch.setattr(w, "send_if_small", lambda ids: ids)
    child = spark.range(500).select((F.col("id") % 90).alias("session_id"), "id").unionByName(
        spark.createDataFrame([(None, 500)], "session_id LONG, id LONG"))
    gone = spark.createDataFrame([(i % 45 * 2,) for i in range(250)] + [(None,)], "id LONG")
    kept = w.cascade_delete({"node_executions": child}, gone)["node_executions"]
    assert {r.id for r in kept.collect()} == {i for i in range(500) if i % 90 % 2} | {500}
    assert kept.columns == child.columns
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert "_gone#" in plan and ", 6), REPARTITION_BY_NUM" in plan


def test_pairs_of_mail_and_folder_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(rv, "TASK_PAIRS", 7)
    mails = spark.createDataFrame([(i, f"alpha w{i % 4} alpha") for i in range(40)] + [(40, None), (41, "zzz")],
                                  "message_id LONG, body STRING")
    folders = spark.createDataFrame([(i, f"Alpha W{i}") for i in (3, 2, 1)] + [(9, None)], "folder_id LONG, name STRING")
    found = rv.match_client(mails, folders)
    want = {i: (i % 4, 2) if i % 4 else (1, 1) for i in range(40)} | {40: (None, None), 41: (None, None)}
    assert {r.message_id: (r.client_folder_id, r.shared_words) for r in found.collect()} == want
    assert ", 24), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_sketches_of_days_merge_to_the_distinct_count_of_a_period(spark):
    n = 60_000
    clicks = spark.range(n).select(
        F.col("id").alias("session_id"), (F.col("id") * 7919 % 20_011).alias("user_id"),
        F.lit("button_click").alias("interaction_type"), F.lit("approve").alias("action_value"),
        F.concat(F.lit("user"), F.col("id") % 2).alias("user_name"), (F.col("id") % 100).cast("int").alias("response_time_ms"),
        (F.lit(DAY) + F.make_dt_interval(F.floor(F.col("id") * 40 / n).cast("int"))).alias("created_at"))
    days = r.interaction_days(clicks)
    assert days.count() == 40
    last = DAY + dt.timedelta(days=39)
    for length in (0, 9, 39):
        want = clicks.filter(F.col("created_at") >= last - dt.timedelta(days=length))
        row = r.interaction_stats_of_days(days, length).first()
        users = want.select("user_id").distinct().count()
        assert row.interaction_count == want.count() and abs(row.unique_users - users) <= 0.02 * users
        got = {v.user_name: v for v in r.engagement_of_days(r.engagement_days(clicks), length).collect()}
        assert all(abs(v.sessions_reviewed - v.total_interactions) <= 0.02 * v.total_interactions for v in got.values())
        assert sum(v.approvals for v in got.values()) == want.count()


def test_matches_and_lines_in_texts_that_hold_the_mark(spark):
    import re

    from reviewflow.operators.scan import MARK, scan_patterns

    texts = [(1, "a1\nb22\n\nc3 a1a1"), (2, f"{MARK}a1{MARK}\nb22{MARK}"), (3, ""), (4, "nothing"), (5, None),
             (6, "$0 \\ a1\n$1")]
    patterns = {"digits": "[a-z]\\d+", "words": "[A-Z]+\\d*\\n?"}
    df = spark.createDataFrame(texts, "doc_id INT, text STRING")
    want = [(i, kind, t.count("\n", 0, m.start()) + 1, m.group()) for i, t in texts for kind, pat in patterns.items()
            for m in re.finditer(f"(?i){pat}", t or "")]
    assert rows(scan_patterns(df, patterns)) == sorted(want, key=repr)
