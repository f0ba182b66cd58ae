"""Tables and logs that are changed in place: only the folders that a change touches are read and written."""

import datetime as dt
import glob
import os

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from reviewflow.functions.ranking import _dealt, number_in_group
from reviewflow.operators import vector_index
from reviewflow.operators import workflow as w
from reviewflow.operators.retrieval import top_k_threads
from reviewflow.operators.vector_index import build_index, search_index
from reviewflow.schemas import DAY
from reviewflow.session import scratch_dir
from reviewflow.sources.keyed import BUCKET, KeyedTable
from reviewflow.sources.logs import drop_days


def files(table):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{table.path}/rows/{BUCKET}=*/*.parquet")}


@pytest.fixture
def table(spark):
    df = spark.range(200).select("id", F.concat(F.lit("v"), "id").alias("v"), (F.col("id") * 2).alias("n"))
    df = df.unionByName(spark.createDataFrame([(None, "none", 0)], "id long, v string, n long"))
    return KeyedTable.create(df, scratch_dir(spark, "keyed") + "/t", "id", 32)


def test_an_update_leaves_the_files_of_other_buckets_alone(spark, table):
    updates = spark.createDataFrame([(3, None, 7), (90, "new", None), (777, "no such key", 1), (None, "x", 1)],
                                    "id int, v string, n long")
    want = rows(w.apply_updates(table.read(), updates, "id", ["v", "n"]))
    before = files(table)
    touched = table.update(updates, ["v", "n"])
    assert rows(table.read()) == want
    assert len(touched) == 3 and touched == table.touched(updates)
    after = files(table)
    kept = {f for f in before if int(f.split(f"{BUCKET}=")[1].split("/")[0]) not in touched}
    assert len(kept) > 20 and all(before[f] == after.get(f) for f in kept)
    assert not any(f in after for f in before if f not in kept and os.path.exists(f) is False)
    assert len(after) <= len(before)


def test_a_look_up_reads_the_folders_of_its_keys(spark, table):
    found = table.find(spark.createDataFrame([(5,), (6,), (5,), (1000,)], "id long"))
    assert sorted(r.id for r in found.collect()) == [5, 6]
    assert f"PartitionFilters: [{BUCKET}" in found._jdf.queryExecution().executedPlan().toString().replace(
        "isnotnull(" + BUCKET, BUCKET) and found.columns == ["id", "v", "n"]


def test_rows_are_put_in_by_key(spark, table):
    new = spark.createDataFrame([(5, "five", 5), (500, "more", 1), (None, "never", 1)], "id long, v string, n long")
    table.upsert(new)
    table.upsert(new)
    got = {r.id: r.v for r in table.read().collect()}
    assert table.read().count() == 202 and got[5] == "five" and got[500] == "more" and got[None] == "none"


def test_any_operator_changes_the_rows_of_the_buckets_it_names(spark, table):
    keys = spark.createDataFrame([(8,)], "id long")
    touched = table.rewrite(keys, lambda df: df.withColumn("n", F.when(F.col("id") == 8, -1).otherwise(F.col("n"))))
    assert len(touched) == 1 and table.find(keys).first().n == -1
    assert KeyedTable(spark, table.path).read().where("n = -1").count() == 1
    assert table.rewrite(keys.where("false"), lambda df: df) == []


def test_changes_with_a_key_twice_are_refused(spark, table):
    twice = spark.createDataFrame([(5, "a"), (5, "b")], "id long, v string")
    before = files(table)
    with pytest.raises(ValueError, match="id = 5"):
        table.update(twice, ["v"])
    assert files(table) == before


def test_an_empty_table_takes_rows(spark):
    empty = spark.createDataFrame([], "k string, _bucket_ string, s struct<a: int, b: array<string>>")
    table = KeyedTable.create(empty, scratch_dir(spark, "keyed") + "/t", "k", 4)
    assert table.read().collect() == []
    table.upsert(spark.createDataFrame([("x", "y", (1, ["z"]))], empty.schema))
    assert [tuple(r) for r in table.read().collect()] == [("x", "y", (1, ["z"]))]


def test_retention_deletes_whole_days_and_rewrites_the_edge(spark):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    data = [(d * 10 + h, at(d, h)) for d in range(1, 9) for h in range(3)] + [(999, None)]
    path = scratch_dir(spark, "retention")
    spark.createDataFrame(data, "id long, created_at timestamp").withColumn(DAY, F.to_date("created_at")) \
        .coalesce(1).write.partitionBy(DAY).parquet(path)
    stat = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/{DAY}=*/*.parquet")}
    before = stat()
    assert drop_days(spark, path, at(4, 1), "created_at") == [f"{DAY}=2024-01-0{d}" for d in (1, 2, 3)]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == sorted(
        i for i, t in data if t is None or t >= at(4, 1))
    after = stat()
    untouched = {f for f in before if not any(f"2024-01-0{d}" in f for d in (1, 2, 3, 4))}
    assert len(untouched) == 5 and all(after[f] == before[f] for f in untouched)
    again = stat()
    assert drop_days(spark, path, at(4, 1), "created_at") == [] and stat() == again


def test_text_ids_of_a_common_beginning_are_numbered_in_even_runs(spark):
    ids = spark.range(9000).select(F.lit("g").alias("g"), F.format_string(
        "a-very-long-common-beginning-%08d", F.col("id") * 7919 % 9000).alias("id"))
    dealt = _dealt(ids, ["g"], "id", 1000).groupBy("_run").count()
    assert dealt.count() >= 8 and max(r["count"] for r in dealt.collect()) <= 2000
    numbered = number_in_group(ids, ["g"], "id", "n", run=1000).collect()
    assert [r.n for r in sorted(numbered, key=lambda r: r.id)] == list(range(1, 9001))


def test_recall_of_the_vector_index(spark, small):
    threads = spark.read.parquet(f"{small}/embeddings.parquet")
    path = scratch_dir(spark, "index")
    build_index(threads, path)
    assert spark.read.parquet(f"{path}/lists").count() == threads.count()
    exact = {(r.query_id, r.vec_id) for r in top_k_threads(threads, threads, 5, skip_self=True).collect()}
    found = {(r.query_id, r.vec_id) for r in search_index(threads, path, 5, skip_self=True).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    rng = np.random.default_rng(3)
    groups = rng.normal(size=(30, 16)).repeat(40, axis=0) + rng.normal(size=(1200, 16)) * 0.15
    grouped = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(groups)], "vec_id long, embedding array<double>")
    build_index(grouped, f"{path}-grouped")
    exact = {(r.query_id, r.vec_id) for r in top_k_threads(grouped, grouped, 5, skip_self=True).collect()}
    found = {(r.query_id, r.vec_id) for r in search_index(grouped, f"{path}-grouped", 5, 4, skip_self=True).collect()}
    assert len(found & exact) >= 0.97 * len(exact)
    few = threads.where("vec_id < 3")
    one = search_index(few, path, 5, probes=1)
    assert {r.query_id for r in one.collect()} == {0, 1, 2}


def test_the_vector_index_leaves_out_what_has_no_direction_and_deals_long_lists(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "PART_ROWS", 10)
    same = [(i, [1.0, 0.0]) for i in range(95)]
    odd = [(200, [0.0, 0.0]), (201, None), (202, [1.0]), (203, [float("nan"), 1.0]), (204, [None, 1.0])]
    df = spark.createDataFrame([*same, (150, [0.6, 0.8]), *odd], "vec_id long, embedding array<double>")
    path = scratch_dir(spark, "index")
    build_index(df, path, lists=2)
    assert {r.vec_id for r in spark.read.parquet(f"{path}/lists").collect()} == {*range(95), 150}
    got = search_index(df.where("vec_id in (7, 150, 201)"), path, 3, probes=2, skip_self=True).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [
        (7, 1, 0), (7, 2, 1), (7, 3, 2), (150, 1, 0), (150, 2, 1), (150, 3, 2)]
