"""Readers of pages, and writers of what queries give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """A Parquet table with a key and text or bytes; only those two columns are read."""
    return spark.read.parquet(path).select(key, html)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One page per file, as bytes whose encoding the parse stage finds: path, html (binary)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("html"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One page per file, as UTF-8 text: path, html."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def from_strings(spark: SparkSession, pages: list[str | None] | dict, key: str = "page_id") -> DataFrame:
    """Pages at hand; null is an empty page."""
    rows = list(pages.items()) if isinstance(pages, dict) else list(enumerate(pages))
    df = spark.createDataFrame(rows, f"{key} {'string' if rows and isinstance(rows[0][0], str) else 'long'}, html string")
    return df.withColumn("html", F.coalesce("html", F.lit("")))


def from_bytes(spark: SparkSession, pages: list[bytes], key: str = "page_id") -> DataFrame:
    return spark.createDataFrame(list(enumerate(pages)), f"{key} long, html binary")


def write_records(records: DataFrame, path: str, column: str = "record") -> None:
    """One text line per record; a record's own line ends stay."""
    records.select(column).write.mode("error").text(path)


def write_table(df: DataFrame, path: str, sort: str | None = None) -> None:
    """Parquet; sorted within its files by a column, so that filters on it skip row groups."""
    (df if sort is None else df.sortWithinPartitions(sort)).write.mode("error").parquet(path)
