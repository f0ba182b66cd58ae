"""Worked cases of the scoring, text and intake expressions."""

import datetime as dt
import json
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewflow.functions import scores as sc
from reviewflow.functions import text as x
from reviewflow.functions import vectors
from reviewflow.functions.vectors import decode_vector
from reviewflow.operators import ingest as g
from reviewflow.operators import retrieval as rv
from reviewflow.operators import review as r
from reviewflow.operators import scan


def values(spark, data, schema, col):
    """``col`` evaluated on each row, in order."""
    schema = "_n INT, " + schema
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(data)], schema)
    return [row[0] for row in df.orderBy("_n").select(col).collect()]


def test_filter_spam(spark):
    mails = [("a", "Test Subject", "Hello, interested in guest", "user@example.com"),
             ("b", "Test Subject", "delivery status notification failed", "user@example.com"),
             ("c", "Test Subject", "Hello there", "Desk@Own.example"),
             ("d", "Test Subject", "whale-floor content here", "user@example.com"),
             ("e", "WHALE-FLOOR", "x", "user@example.com"),
             ("f", None, None, "user@example.com"), ("g", "x", "x", ""), ("h", "x", "x", None),
             ("i", "x", "x", "PAYMENTS-noreply@google.com")]
    df = spark.createDataFrame(mails, "id STRING, subject STRING, body STRING, sender_email STRING")
    own = g.IGNORED_SENDERS + ["desk@own.example"]
    assert [m[0] for m in rows(g.filter_spam(df, ignore=own).select("id"))] == ["a", "f"]
    capital = g.filter_spam(df, keywords=["HELLO"], ignore=[])
    assert capital.filter("id = 'a'").count() == 1


def test_clean_text(spark):
    got = values(spark, [("Hello\t\tworld\r\nwith\tstrange   spacing",), (None,), ("",)],
                 "s STRING", x.clean_text(F.col("s")))
    assert got == ["Hello  world\n\nwith strange   spacing", "", ""]


def test_email_hash_keeps_null_places(spark):
    import hashlib

    want = [hashlib.sha256(s.encode()).hexdigest() for s in ("a|b", "|b", "a|", "|")]
    assert values(spark, [("a", "b"), (None, "b"), ("a", None), (None, None)],
                  "a STRING, b STRING", x.email_hash(F.col("a"), F.col("b"))) == want


def test_template_score(spark):
    got = values(spark, [(n,) for n in (99, 100, 199, 200, 500, 501, 800, 801)], "n INT",
                 sc.template_score(F.col("n")))
    assert got == [.2, .5, .5, 1, 1, .8, .8, .6]


def test_quality_score(spark):
    data = [("approved", 5, 0), ("approved", 4, 49), ("approved", None, 199), ("approved", 5, 200),
            ("rejected", 1, 0), ("rated", 4, 0), ("edited", None, 0), ("rated", None, 0)]
    got = values(spark, data, "a STRING, r INT, e INT",
                 sc.quality_score(F.col("a"), F.col("r"), F.col("e")))
    assert got == [1.0, 0.77, 0.3, 0.4, 0.08, 0.8, 0.0, 0.0]


def test_edit_type(spark):
    got = values(spark, [(n,) for n in (0, 1, 49, 50, 199, 200)], "n INT", sc.edit_type(F.col("n")))
    assert got == [None, "minor", "minor", "major", "major", "complete_rewrite"]


def positional(a, b):
    return abs(len(a) - len(b)) + sum(p != q for p, q in zip(a, b))


def test_edit_distance_cases(spark):
    data = [("abcd", "abxyz"), ("same", "same"), ("", "abc"), ("", ""), (None, "ab"),
            ("We could talk on Monday.", "We could meet on a Monday, perhaps.")]
    got = values(spark, data, "a STRING, b STRING", sc.edit_distance(F.col("a"), F.col("b")))
    assert got == [3, 0, 3, 0, 2, positional(*data[-1])]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("abé\n ", max_size=12), st.text("abé\n ", max_size=12)),
                min_size=1, max_size=20))
def test_edit_distance_properties(spark, pairs):
    there = values(spark, pairs, "a STRING, b STRING", sc.edit_distance(F.col("a"), F.col("b")))
    back = values(spark, pairs, "a STRING, b STRING", sc.edit_distance(F.col("b"), F.col("a")))
    assert there == back == [positional(a, b) for a, b in pairs]


def test_draft_indicators_and_signature(spark):
    drafts = [("Hi there, thanks. Ann",), ("Good Morning",), ("x",), ("x regards\n",)]
    assert values(spark, drafts, "d STRING", sc.draft_indicators(F.col("d"), "Ann")) == [3, 1, 0, 1]
    got = values(spark, [("Text \n",), ("Text\nAnn \t\n",)], "d STRING",
                 sc.with_signature(F.col("d"), "\n\nAnn", ["Ann"]))
    assert got == ["Text\n\nAnn", "Text\nAnn \t\n"]


def test_extract_json(spark):
    texts = [('x {"a":1} y {"b":2} z',), ("no brace",), ('say {"a": {"c": "}"}} ok',), ("{bad",),
             ('{"a": 1}\n',)]
    got = values(spark, texts, "s STRING", x.extract_json(F.col("s"), "a STRING"))
    assert [v.status for v in got] == ["bad_json", "no_json", None, "no_json", None]
    assert [v.value and v.value.a for v in got] == [None, None, '{"c":"}"}', None, "1"]


def test_rejection_parse(spark):
    nested = 'a {"x": {"y": 1}} then {"rejection_type":"Soft Rejection","angles":["p","q"]} end'
    got = values(spark, [(nested,), ("{bad}",), ("nothing",), ('} {',), ('{"angles": ["p"]}',)],
                 "s STRING", x.rejection_parse(F.col("s")))
    assert [(v.rejection_type, v.angles) for v in got] == [
        ("Soft Rejection", ["p", "q"]), ("Hard Rejection", []), ("Hard Rejection", []),
        ("Hard Rejection", []), ("Hard Rejection", ["p"])]


def test_tagged_body(spark):
    got = values(spark, [("<analysis>a</analysis><response> hi </response>",), ("no tags",),
                         ("<response>open",)], "s STRING", x.tagged_body(F.col("s")))
    assert got == ["hi", "no tags", "<response>open"]


def test_label_from_notice(spark):
    got = values(spark, [("x\nClassification: Accepted \t\nmore",), ("none",),
                         ("Classification:\nnext",), ("Classification: a Classification: b",)], "s STRING",
                 x.label_from_notice(F.col("s")))
    assert got == ["Accepted", "N/A", "", "a"]


def test_session_from_action(spark):
    got = values(spark, [("rate_quality_1234abcd", "rate_5_1234abcd"), ("x", "a_12345678_b"),
                         ("x", "y"), ("a_b", "c_d")], "a STRING, v STRING",
                 x.session_from_action(F.col("a"), F.col("v")))
    assert got == ["1234abcd", "12345678", None, None]


def test_pretty_name_keeps_capitals(spark):
    names = [("draft_emailID_v2",), ("pre-call_q's",), ("",), ("_x  y",), (None,)]
    assert values(spark, names, "n STRING", x.pretty_name(F.col("n"))) == \
        ["Draft EmailID V2", "Pre-Call Q'S", "", " X  Y", None]


def test_render(spark):
    got = values(spark, [(["one"],)], "a ARRAY<STRING>", x.render(
        F.lit("{{angle1}}/{{angle2}}/$1"),
        {"{{angle1}}": x.angle(F.col("a"), 0), "{{angle2}}": x.angle(F.col("a"), 1)}))
    assert got == ["one/No specific angle available/$1"]


def test_clicks_to_feedback(spark):
    user = {"id": "U1", "name": "tester"}
    session = "0f8fad5b-d9cb-469f-a165-70867728950e"
    clicks = [(json.dumps({"user": user, "actions": [
        {"action_id": a, "value": json.dumps({"session_id": session, **more})}]}),)
        for a, more in (("rate_4", {"rating": 4}), ("approve_draft", {}), ("edit_draft", {}),
                        ("reject_draft", {}), ("other", {}))]
    clicks.append((json.dumps({"user": user, "actions": []}),))
    df = spark.createDataFrame(clicks, "payload STRING")
    got = rows(r.feedback_from_clicks(df).select("human_action", "human_rating",
                                                 "final_quality_score", "slack_message_id"))
    assert got == [("approved", 5, 1.0, "0f8fad5b"), ("edited", None, 0.0, "0f8fad5b"),
                   ("rated", 4, 0.8, "0f8fad5b"), ("rejected", 1, 0.08, "0f8fad5b")]


def test_parse_interactions(spark):
    body = {"user": {"id": "U1", "name": "n"}, "channel": {"id": "C"}, "message": {"ts": "1.2"},
            "trigger_id": "T", "actions": [
                {"action_id": "rate", "type": "static_select",
                 "selected_option": {"value": "rate_5_1234abcd"}}]}
    df = spark.createDataFrame([(json.dumps(body),)], "payload STRING")
    got = rows(r.parse_interactions(df).drop("payload"))
    assert got == [("1234abcd", "selection", "rate", "U1", "n", "C", "1.2", "T")]


def test_doc_text_order_and_depth(spark):
    para = lambda s: {"paragraph": {"elements": [{"textRun": {"content": s}}]}}
    table = lambda *cells: {"table": {"tableRows": [
        {"tableCells": [{"content": [c]} for c in cells]}]}}
    flat = [para("a"), table(para("b"), para("c")), para("d")]
    deep = para("x")
    for n in range(40):
        deep = table(para(str(n % 10)), deep)
    odd = [{"paragraph": {"elements": [{"textRun": None}, {}, None]}}, {"table": None}, None, {"table": {}}]
    df = spark.createDataFrame([(1, json.dumps(flat)), (2, json.dumps([deep])), (3, None), (4, "[broken"),
                                (5, json.dumps(odd)), (6, "7")], "id INT, content STRING")
    assert rows(rv.doc_text(df)) == [
        (1, "abcd"), (2, "9876543210" * 4 + "x"), (3, ""), (4, ""), (5, ""), (6, "")]


def test_decode_vector(spark):
    import base64

    blob = base64.b64encode(np.array([1.0, -2.5], dtype="<f4").tobytes()).decode()
    blobs = [blob, json.dumps({"$binary": blob}), None, "#?", base64.b64encode(b"abc").decode()]
    df = spark.createDataFrame([(b,) for b in blobs], "b STRING")
    assert [v for (v,) in decode_vector(df, "b").select("vector").collect()] == \
        [[1.0, -2.5], [1.0, -2.5], None, None, None]


def test_parse_form(spark):
    full = {"values": {"b1": {"x": {"initial_value": "old@x", "value": "new@x"}},
                       "b2": {"y": {"initial_value": "Re", "value": "Subject"}},
                       "b3": {"z": {"multiline": True, "value": "Body"}}}}
    part = {"values": {"b1": full["values"]["b1"]}}
    df = spark.createDataFrame([(1, json.dumps(full)), (2, json.dumps(part)), (3, "{}")],
                               "id INT, state STRING")
    assert rows(rv.parse_form(df)) == [
        (1, "new@x", "Subject", "Body", None), (2, "new@x", None, None, "incomplete form"),
        (3, None, None, None, "incomplete form")]


def test_route(spark):
    data = [("no", "Accepted"), (" No ", "x"), ("nope", "Topic-based rejection"),
            (None, "Accepted"), ("yes", None)]
    df = spark.createDataFrame(data, "decision STRING, label STRING")
    assert [v.route for v in g.route(df).collect()] == [
        "end", "end", "handle_rejection", "standard_pipeline", "standard_pipeline"]


@pytest.mark.parametrize("text,label", [
    ("Sorry, but we do not allow guests on the show.", "No Guests"),
    ("At the moment we only accept women as guests.", "Identity-based rejection"),
    ("We only accept tech guests.", "Topic-based rejection"),
    ("We only accept CEOs these days.", "Qualification-based rejection"),
    ("There are paid slots only.", "Pay-to-Play"),
    ("We'd love to have you!", "Accepted"),
    ("We'd love to have you but we have a few questions first.", "Conditional"),
    ("I am out of the office.", "Others"), (None, "Others")])
def test_classify_rules(spark, text, label):
    df = spark.createDataFrame([(text,)], "text STRING")
    assert scan.classify_rules(df).first().label == label


def test_scan_lines_match_python(spark):
    import re

    text = "a\npassword = 'p1'\n\ntoken=\"t\n1\" x token = 'yes' \n api_key='your_key'\ntoken='" + \
        "z" * 60 + "'"
    df = spark.createDataFrame([(1, text)], "doc_id INT, text STRING")
    want = []
    for kind, pattern in scan.SECRET_PATTERNS.items():
        for m in re.finditer(pattern, text, re.IGNORECASE):
            found = m.group(0)
            if not any(w in found.lower() for w in scan.PLACEHOLDERS):
                want.append((1, kind, text[:m.start()].count("\n") + 1,
                             found[:50] + "..." if len(found) > 50 else found))
    assert len(want) == 4
    assert rows(scan.scan_secrets(df)) == sorted(want, key=repr)


def test_fresh_only(spark):
    now = dt.datetime(2024, 1, 1, 12)
    data = [(i, now + dt.timedelta(seconds=s)) for i, s in enumerate((-301, -300, 0, 300, 301))]
    df = spark.createDataFrame(data, "id INT, ts TIMESTAMP")
    assert [v for (v,) in rows(g.fresh_only(df, "ts", F.lit(now)).select("id"))] == [1, 2, 3]


def _most_mb(work) -> float:
    """Most MB of Python objects and numpy arrays held at once."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_vectors_are_decoded_without_a_value_each():
    floats = np.arange(1000, dtype="<f4")
    blobs = pa.array([floats.tobytes(), None, b"", b"abc"] * 1000, pa.binary())
    got = []
    assert _most_mb(lambda: got.append(vectors._floats.func(blobs))) < 10
    assert got[0].slice(0, 4).to_pylist() == [floats.tolist(), None, [], None] == got[0].slice(3996).to_pylist()
    assert vectors._floats.func(pa.array([None, b"x"], pa.binary())).to_pylist() == [None, None]
    assert vectors._floats.func(blobs.slice(1, 4)).to_pylist() == [None, [], None, floats.tolist()]


def test_texts_are_compared_a_pair_at_a_time(spark):
    long = pa.array(["é" * 5000] * 1000)
    other = pa.array(["é" * 4000 + "x"] * 1000)
    got = []
    assert _most_mb(lambda: got.append(sc._differences.func(long, other))) < 2
    assert got[0].to_pylist() == [1000] * 1000
    # A batch for a worker ends by its bytes.
    sized = F.arrow_udf(lambda x: pa.array([x.nbytes] * len(x), pa.int64()), "long")
    texts = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("x"), F.lit(20_000)).alias("text"))
    assert texts.select(F.max(sized("text"))).first()[0] < 20 << 20
