"""Quotes for flight requests that arrive as files.

Quotes depend on one request only, so the stream needs no state, no watermark and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from farelens.operators.quotes import expected_margin, quote_flights, quote_labels, quote_ranges
from farelens.schema import REQUEST_SCHEMA


def read_requests(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of requests from JSON files below ``path``."""
    return (
        spark.readStream.schema(REQUEST_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )


def price_requests(requests: DataFrame) -> DataFrame:
    """Every figure and label of a quote, for a batch or a stream of requests."""
    for step in (quote_flights, expected_margin, quote_ranges, quote_labels):
        requests = requests.transform(step)
    return requests


def write_quotes(quotes: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer that appends quotes as Parquet; the caller picks the trigger and starts it."""
    return (
        quotes.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
