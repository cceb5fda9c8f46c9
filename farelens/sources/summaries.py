"""The nested data summary as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farelens.schema import SUMMARY_SCHEMA


def write_summary(df: DataFrame, path: str) -> None:
    """Write summary rows as JSON; missing figures are written as ``null`` and not left out."""
    (
        df.write.mode("overwrite")
        .option("ignoreNullFields", False)
        .option("dateFormat", "yyyy-MM-dd")
        .option("timestampFormat", "yyyy-MM-dd")
        .json(path)
    )


def write_document(lines: DataFrame, path: str) -> None:
    """Write the lines of a summary document (``summary_document``) as text files that follow one another.

    The lines are sorted across partitions, so every task writes a stretch of the document; the files, in the order of their names,
    are one JSON text.
    """
    lines.orderBy("section", "route_name").select("line").write.mode("overwrite").option("encoding", "UTF-8").text(path)


def read_document_routes(spark: SparkSession, path: str) -> DataFrame:
    """route_name and profile of every route of a written document, read line by line in any number of tasks."""
    entry = F.regexp_extract("value", '^,?(".*)$', 1)
    kind = T.MapType(T.StringType(), SUMMARY_SCHEMA["route_stats"].dataType.valueType)
    parsed = F.from_json(F.concat(F.lit("{"), entry, F.lit("}")), kind)
    return spark.read.text(path).filter(entry != "").select(F.explode(parsed).alias("route_name", "profile"))


def read_summary_elasticity(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Routes and their elasticity from stored summaries, one a line; routes without a figure are skipped.

    ``multi_line``: each file is one indented document instead.
    """
    summary = spark.read.schema(SUMMARY_SCHEMA).option("multiLine", multi_line).json(path)
    return (
        summary.select(F.explode("route_stats").alias("route_name", "profile"))
        .select("route_name", F.col("profile.price_elasticity").alias("price_elasticity"))
        .filter(F.col("price_elasticity").isNotNull())
    )
