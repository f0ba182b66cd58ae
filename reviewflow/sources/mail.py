"""Mail feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewflow.schemas import RAW_MAIL

# Mails taken from one feed per poll; one file holds one mail page.
PAGE_FILES = 50


def mail_stream(spark: SparkSession, path: str, files_per_poll: int = PAGE_FILES) -> DataFrame:
    """Unread mail arriving as JSON files."""
    return spark.readStream.schema(RAW_MAIL).option("maxFilesPerTrigger", files_per_poll).json(path)


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_MAIL).json(path)
