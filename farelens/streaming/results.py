"""Results keyed by question, kept while responses arrive.

The state holds one response for each question: the one with the largest ``seq`` seen so far, whenever it arrived. Repeated and late
responses therefore change nothing, or only what they are newer than. There is no watermark: a question may be answered again at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

_KEPT = ("reasoning", "answer", "response_json")


def latest_results(responses: DataFrame) -> DataFrame:
    """query, seq and the latest response of each question, for a stream or a batch of parsed responses."""
    row = F.struct(*_KEPT)
    found = responses.groupBy("query").agg(F.max("seq").alias("seq"), F.max_by(row, "seq").alias("kept"))
    return found.select("query", "seq", "kept.*")


def write_results(responses: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer that stores each batch's changed results below ``path``; the caller picks the trigger and starts it.

    A batch that is run again after a failure replaces its own files.
    """

    def store(changed: DataFrame, epoch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}")

    return latest_results(responses).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """query, reasoning, answer, response_json: the table that ``results_table`` makes of all responses at once."""
    return latest_results(spark.read.parquet(path)).drop("seq")
