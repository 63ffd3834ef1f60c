"""The parse stage under Structured Streaming.

It keeps nothing between pages, so it runs on a stream as it does on a table; results are
appended, and the sink's checkpoint makes them exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sparkdom.operators.parse import parse_events, parse_pages
from sparkdom.operators.select import select


def read_stream(spark: SparkSession, path: str, columns: str = "page_id long, url string, html string", files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they come into a folder."""
    reader = spark.readStream.schema(columns)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def select_stream(pages: DataFrame, selector: str, fields: Sequence[str] = ("pos", "name", "text"), **options) -> DataFrame:
    return select(pages, selector, fields, **options)


def parse_stream(pages: DataFrame, **options) -> DataFrame:
    return parse_pages(pages, **options)


def event_stream(pages: DataFrame, **options) -> DataFrame:
    return parse_events(pages, **options)


def run_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived as Parquet, then stop."""
    q = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return q
