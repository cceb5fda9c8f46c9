"""Rule-based price recommendations for routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens import fixed_values as fixed
from farelens.operators.stats import STAT_MEANS, route_stats


def _rule(load: Column, profit: Column, part: int) -> Column:
    """First matching rule's strategy, adjustment or reason; zero profit falls through to keeping."""

    def value(rule) -> Column:
        return F.lit(rule[part])

    high, low = load > fixed.HIGH_LOAD, load < fixed.LOW_LOAD
    middle = load.between(fixed.LOW_LOAD, fixed.HIGH_LOAD)
    return (
        F.when(high & (profit < 0), value(fixed.RAISE))
        .when(high & (profit > 0), value(fixed.SMALL_RAISE))
        .when(low & (profit < 0), value(fixed.LOWER))
        .when(middle & (profit < 0), value(fixed.OPTIMISE_COST))
        .otherwise(value(fixed.KEEP))
    )


def recommend(stats: DataFrame) -> DataFrame:
    """Recommendations from route statistics that exist already."""
    load, profit = F.col("avg_load_factor"), F.col("avg_profit_rate")
    return (
        stats.select(
            "route_name",
            F.col("load_factor").alias("avg_load_factor"),
            F.col("avg_ticket_price").alias("avg_price"),
            F.col("profit_rate").alias("avg_profit_rate"),
            F.col("marginal_contribution_rate").alias("avg_marginal_rate"),
        )
        .withColumn("strategy", _rule(load, profit, 0))
        .withColumn("price_adjustment", _rule(load, profit, 1))
        .withColumn(
            "recommended_price",
            F.col("avg_price") * (F.lit(1.0) + F.col("price_adjustment")),
        )
        .withColumn("reason", _rule(load, profit, 2))
        .orderBy(F.desc("avg_profit_rate"), "route_name")
    )


def pricing_recommendations(df: DataFrame) -> DataFrame:
    """Strategy, adjustment, new price and reason per route, best mean profit rate first.

    Works on raw margins: capped ones never have a negative mean.
    """
    return recommend(route_stats(df, STAT_MEANS))
