"""Prompt texts, one row per question or per flight request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farelens import fixed_values as fixed
from farelens.functions import yes_no


def _template(lines: tuple[str, ...]) -> str:
    indent = fixed.PROMPT_INDENT
    return "\n" + "".join(f"{indent}{line}\n" for line in lines) + indent


ANALYSIS_TEMPLATE = _template(fixed.ANALYSIS_PROMPT_LINES)
QUOTE_TEMPLATE = _template(fixed.QUOTE_PROMPT_LINES)


def default_queries(spark: SparkSession) -> DataFrame:
    """The five standing questions, in order."""
    rows = list(enumerate(fixed.DEFAULT_QUERIES, start=1))
    return spark.createDataFrame(rows, "seq LONG, query STRING")


def analysis_prompts(summary_json: DataFrame, queries: DataFrame) -> DataFrame:
    """One prompt per question over a one-row table ``summary_json``; the data enters as a scalar."""
    data = summary_json.select("summary_json").scalar()
    return queries.withColumn(
        "prompt", F.format_string(ANALYSIS_TEMPLATE, data, F.col("query"))
    )


def quote_prompts(requests: DataFrame) -> DataFrame:
    """One pricing prompt per flight request."""
    fields = (
        F.col("route"),
        F.col("date"),
        yes_no(F.col("is_holiday")),
        F.col("day_of_week"),
        F.col("aircraft_type"),
        F.col("seat_capacity").cast("string"),
        F.col("price_elasticity").cast("string"),
        F.col("seasonal_index").cast("string"),
        F.col("load_factor").cast("string"),
        F.col("competitor_load_factor").cast("string"),
        F.col("historical_load_factor").cast("string"),
        F.col("competitor_price").cast("string"),
    )
    return requests.withColumn("prompt", F.format_string(QUOTE_TEMPLATE, *fields))
