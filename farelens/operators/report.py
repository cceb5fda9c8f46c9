"""Formatted rows of the route report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.functions import money_text, percent_text, sign_class


def route_rows(stats: DataFrame) -> DataFrame:
    """Route statistics as shown: percents and money as text, with the sign class of both rates."""
    return stats.select(
        "route_name",
        percent_text(F.col("load_factor")).alias("load_factor"),
        money_text(F.col("avg_ticket_price")).alias("avg_ticket_price"),
        percent_text(F.col("profit_rate")).alias("profit_rate"),
        sign_class(F.col("profit_rate")).alias("profit_class"),
        percent_text(F.col("marginal_contribution_rate")).alias("marginal_contribution_rate"),
        sign_class(F.col("marginal_contribution_rate")).alias("marginal_class"),
        F.col("flight_count").cast("string").alias("flight_count"),
    )


def recommendation_rows(recommendations: DataFrame) -> DataFrame:
    """Recommendations as shown: adjustment with one decimal, the rest with two."""
    return recommendations.select(
        "route_name",
        money_text(F.col("avg_price")).alias("avg_price"),
        percent_text(F.col("avg_load_factor")).alias("avg_load_factor"),
        percent_text(F.col("avg_profit_rate")).alias("avg_profit_rate"),
        sign_class(F.col("avg_profit_rate")).alias("profit_class"),
        "strategy",
        percent_text(F.col("price_adjustment"), 1).alias("price_adjustment"),
        money_text(F.col("recommended_price")).alias("recommended_price"),
        "reason",
    )


def report_rows(stats: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Statistics and recommendation of every route in one formatted row."""
    advice = recommendation_rows(recommendations).select(
        "route_name", "strategy", "price_adjustment", "recommended_price", "reason"
    )
    return route_rows(stats).join(advice, "route_name")
