"""The corpus pipeline: documents pass the stages in order, each written and read again.

The pipeline is held against a brute-force version in ``tests/llm``; its stages learn from data, which
SQL cannot express.

Defined results: texts that are null or hold no letter go at the first stage if any language could be learned,
and stay if no row has a label; of equal or near texts, empty ones included, the row of the least id stays, a
null id after all others and one row where ids repeat; a document that loses all its words stays as an empty one;
a text of any length is one document throughout; other columns are kept by all stages but the last; an empty
table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewflow.llm import decontaminate, language, near_dups, packing, substring
from reviewflow.session import scratch_dir

STAGES = [
    ("language_id", language.stage),
    ("near_dedup", near_dups.stage),
    ("substring_dedup", substring.stage),
    ("decontamination", decontaminate.stage),
    ("packing", packing.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = scratch_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
