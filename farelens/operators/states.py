"""Kept partial states: what every report figure is made of, by route, month and weekday, merged batch by batch.

A state holds counts, sums, products for the correlation and the trend, the first and the last date, and a distinct-count sketch of
the flight numbers. All of them merge: the states of a batch join those kept before, and the flights of earlier batches are not read again. Figures from
states equal those of ``operators.stats`` over all flights, in their columns and order.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farelens.functions import ratio, weekday_label
from farelens.operators.stats import DISTINCT_BITS, STAT_MEANS

KEYS = ("route_name", "month", "day_of_week")
MEASURES = (*STAT_MEANS, "total_revenue", "total_cost", "profit")
#: Products of load (x) and price (y) over flights that have both.
_PRODUCTS = ("xy_n", "x_sum", "y_sum", "xx_sum", "yy_sum", "xy_sum")
_SUMS = (*[f"{m}_{part}" for m in MEASURES for part in ("sum", "n")], *_PRODUCTS, "flights", "rows")


def flight_states(flights: DataFrame) -> DataFrame:
    """States of the flights: one row for each route, month and weekday, in one aggregation.

    The month comes from ``flight_date``. Rows without a route or weekday have states of their own; a measure that the table lacks
    has no values.
    """
    have = set(flights.columns)
    x, y = F.col("load_factor").cast("double"), F.col("avg_ticket_price").cast("double")
    both = x.isNotNull() & y.isNotNull()
    pair = lambda value: F.sum(F.when(both, value))
    parts = []
    for m in MEASURES:
        value = F.col(m) if m in have else F.lit(None).cast("double")
        parts += [F.sum(value).alias(f"{m}_sum"), F.count(value).alias(f"{m}_n")]
    parts += [F.count_if(both).alias("xy_n")]
    parts += [pair(v).alias(n) for v, n in zip((x, y, x * x, y * y, x * y), _PRODUCTS[1:], strict=True)]
    return (
        flights.withColumn("month", F.month("flight_date"))
        .groupBy(*KEYS)
        .agg(
            *parts,
            F.count("flight_id").alias("flights"),
            F.count(F.lit(1)).alias("rows"),
            F.min("flight_date").alias("first_date"),
            F.max("flight_date").alias("last_date"),
            F.hll_sketch_agg("flight_number", F.lit(DISTINCT_BITS)).alias("numbers"),
        )
    )


def merge_states(*states: DataFrame) -> DataFrame:
    """States of several batches as those of all their flights."""
    every = functools.reduce(DataFrame.unionByName, states)
    return every.groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.hll_union_agg("numbers").alias("numbers"),
    )


def keep_states(states: DataFrame, path: str, batch: str) -> None:
    """Store a batch's states below ``path``; a batch that is stored again replaces itself, so a retry counts once."""
    states.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def kept_states(spark: SparkSession, path: str) -> DataFrame:
    """All batches below ``path`` as one table of states."""
    return merge_states(spark.read.parquet(path).drop("batch"))


def _mean(measure: str) -> Column:
    return ratio(F.sum(f"{measure}_sum"), F.sum(f"{measure}_n"))


def _by(states: DataFrame, *keys: str):
    return states.filter(F.col(keys[0]).isNotNull()).groupBy(*keys)


def overview(states: DataFrame, n_columns: int) -> DataFrame:
    """As ``stats.overview``: routes exactly, flight numbers by their sketches."""
    return states.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"),
        F.lit(n_columns).cast("long").alias("n_columns"),
        F.count_distinct("route_name").alias("n_routes"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("numbers")), F.lit(0)).alias("n_flight_numbers"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )


def overall_means(states: DataFrame) -> DataFrame:
    return states.agg(*[_mean(m).alias(m) for m in STAT_MEANS])


def route_stats(states: DataFrame, measures: Sequence[str] | None = None) -> DataFrame:
    means = [_mean(m).alias(m) for m in (measures or STAT_MEANS)]
    if measures:
        return _by(states, "route_name").agg(*means).orderBy("route_name")
    sums = [F.sum(f"{m}_sum").alias(m) for m in ("total_revenue", "profit")]
    found = _by(states, "route_name").agg(*means, *sums, F.sum("flights").alias("flight_count"))
    return found.orderBy(F.desc("profit_rate"), "route_name")


def _moments(states: DataFrame) -> DataFrame:
    """Means of load and price, and their central products over the number of flights that have both."""
    total = states.agg(*[F.sum(c).alias(c) for c in _PRODUCTS])
    n = F.col("xy_n")
    x, y = ratio(F.col("x_sum"), n), ratio(F.col("y_sum"), n)
    return total.select(
        n.alias("n"),
        x.alias("x"),
        y.alias("y"),
        (ratio(F.col("xx_sum"), n) - x * x).alias("xx"),
        (ratio(F.col("yy_sum"), n) - y * y).alias("yy"),
        (ratio(F.col("xy_sum"), n) - x * y).alias("xy"),
    )


#: Share of a mean square below which a central product is taken for the noise of its summation.
_NOISE = 1e-13


def _spread(product: str, mean: str) -> Column:
    return F.when(F.col(product) > F.col(mean) * F.col(mean) * _NOISE, F.col(product)).otherwise(0.0)


def load_price_corr(states: DataFrame) -> DataFrame:
    return _moments(states).select(ratio(F.col("xy"), F.sqrt(_spread("xx", "x") * _spread("yy", "y"))).alias("load_price_corr"))


def load_price_trend(states: DataFrame) -> DataFrame:
    """Least-squares line of price on load in percent."""
    slope = ratio(F.col("xy"), _spread("xx", "x"))
    return _moments(states).select((slope / 100.0).alias("slope"), (F.col("y") - slope * F.col("x")).alias("intercept"))


def profit_by_route(states: DataFrame, ascending: bool = False) -> DataFrame:
    means = _by(states, "route_name").agg((_mean("profit_rate") * F.lit(100.0)).alias("profit_pct"))
    return means.orderBy(F.asc("profit_pct") if ascending else F.desc("profit_pct"), "route_name")


def revenue_cost_by_route(states: DataFrame) -> DataFrame:
    means = _by(states, "route_name").agg(_mean("total_revenue").alias("avg_revenue"), _mean("total_cost").alias("avg_cost"))
    return means.withColumn("avg_profit", F.col("avg_revenue") - F.col("avg_cost")).orderBy(F.desc("avg_profit"), "route_name")


def weekday_load(states: DataFrame) -> DataFrame:
    means = _by(states, "day_of_week").agg(_mean("load_factor").alias("avg_load_factor"))
    return means.withColumn("day_name", weekday_label(F.col("day_of_week"))).orderBy("day_of_week")


def report_kpis(states: DataFrame) -> DataFrame:
    return states.agg(
        (_mean("load_factor") * F.lit(100.0)).alias("avg_load_factor"),
        (_mean("profit_rate") * F.lit(100.0)).alias("avg_profit_margin"),
        F.count_distinct("route_name").alias("total_routes"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_samples"),
    )


def _seasons(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean price of a month over the mean price of all months of the keys; thirteen rows at most meet in a window."""
    price = "avg_ticket_price"
    monthly = states.groupBy(*keys, "month").agg(F.sum(f"{price}_sum").alias("s"), F.sum(f"{price}_n").alias("n"))
    whole = Window.partitionBy(*keys)
    overall = ratio(F.sum("s").over(whole), F.sum("n").over(whole))
    found = monthly.withColumn("seasonal_index", ratio(ratio(F.col("s"), F.col("n")), overall))
    return found.filter(F.col("month").isNotNull()).select(*keys, "month", "seasonal_index")


def monthly_seasonal_index(states: DataFrame) -> DataFrame:
    return _seasons(states, []).orderBy("month")


def route_seasonal_index(states: DataFrame) -> DataFrame:
    return _seasons(states.filter(F.col("route_name").isNotNull()), ["route_name"])
