"""The pipeline, stage by stage on each stage's own input, against plain versions."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import texts as plain  # noqa: E402
from test_operators import check_packing  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, items = docs.columns, spark.read.parquet(f"{small}/benchmark.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            check_packing(docs.collect(), [(i, r.text) for i, r in before.items()], 2048)
            break
        assert docs.columns == columns
        after, texts = {r.doc_id: r for r in docs.collect()}, {i: r.text for i, r in before.items()}
        if name == "language_id":
            assert after.keys() == {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}
        elif name == "near_dedup":
            assert after.keys() == {i for i, g in plain.groups(texts).items() if i == g}
        elif name == "substring_dedup":
            assert {i: plain.words(r.text) for i, r in after.items()} == plain.without_repeats(texts)
            assert all(r.n_chars == len(r.text) for r in after.values())
        else:
            found = plain.leaks(texts, {r.item_id: r.text for r in items.collect()})
            assert after.keys() == texts.keys() - {i for i, _ in found}
        before = after


def test_run_is_the_stages_in_order(spark, small):
    whole = corpus_pipeline.run(spark, small)
    assert whole.count() and "sequence_id" in whole.columns
    assert entry.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    items = spark.createDataFrame([(1, "one two three"), (2, None)], "item_id long, text string")
    for name, docs, left in (("odd", plain.odd_table(spark, extra=False), {8, 12, None}),
                             ("unlabelled", plain.odd_table(spark, extra=False).selectExpr(
                                 "doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars"),
                              {5, 7, 8, 11, 12, None}),
                             ("none", plain.empty_table(spark), set())):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        pieces = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in pieces} == left, name
