"""Route profiles and the overall figures of a cleaned table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.fixed_values import MIN_ELASTICITY_ROWS
from farelens.functions import ratio, rounded_mean
from farelens.operators.elasticity import elasticity_or_supplied

_MEANS = {
    "avg_price": "ticket_price",
    "avg_load_factor": "load_factor",
    "avg_profit_margin": "profit_margin",
}


def seasonal_map(profile: DataFrame) -> DataFrame:
    """Turn the month entries of a profile into a map ``month as text -> index``, months in order."""
    entries = F.transform(
        "seasonal_index",
        lambda e: F.struct(
            e["month"].cast("string").alias("key"), rounded_mean(e["ratio"]).alias("value")
        ),
    )
    return profile.withColumn("seasonal_index", F.map_from_entries(entries))


def route_profile(df: DataFrame, min_rows: int = MIN_ELASTICITY_ROWS) -> DataFrame:
    """Price, load and margin means, elasticity, season map and row count per route, rounded to 2.

    The means and the season come from one aggregation to (route, month), rolled up per route. Tables
    without months take the mean supplied ``seasonal_index`` or 1.0 under the key ``avg``.
    """
    has_month, has_season = "month" in df.columns, "seasonal_index" in df.columns
    month = F.col("month") if has_month else F.lit(None).cast("int")
    season = F.col("seasonal_index") if has_season else F.lit(None).cast("double")
    cells = (
        df.filter(F.col("route_name").isNotNull())
        .groupBy("route_name", month.alias("month"))
        .agg(
            *[
                part
                for name, source in _MEANS.items()
                for part in (
                    F.sum(source).alias(f"{name}_sum"),
                    F.count(source).alias(f"{name}_n"),
                )
            ],
            F.sum(season).alias("season_sum"),
            F.count(season).alias("season_n"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    month_cell = F.struct(
        "month", ratio(F.col("avg_price_sum"), F.col("avg_price_n")).alias("mean")
    )
    rolled = cells.groupBy("route_name").agg(
        *[
            ratio(F.sum(f"{name}_sum"), F.sum(f"{name}_n")).alias(f"{name}_raw")
            for name in _MEANS
        ],
        ratio(F.sum("season_sum"), F.sum("season_n")).alias("season_raw"),
        F.sum("n").alias("sample_count"),
        # At most twelve entries; rows without a month take no part.
        F.array_sort(F.collect_list(F.when(F.col("month").isNotNull(), month_cell))).alias(
            "cells"
        ),
    )
    means = {name: rounded_mean(F.col(f"{name}_raw")) for name in _MEANS}
    if has_month:
        shaped = rolled.withColumn(
            "seasonal_index",
            F.transform(
                "cells",
                lambda c: F.struct(
                    c["month"].alias("month"),
                    ratio(c["mean"], F.col("avg_price_raw")).alias("ratio"),
                ),
            ),
        ).transform(seasonal_map)
    else:
        value = rounded_mean(F.col("season_raw")) if has_season else F.lit(1.0)
        shaped = rolled.withColumn("seasonal_index", F.create_map(F.lit("avg"), value))
    shaped = shaped.withColumns(means)
    elasticity = elasticity_or_supplied(df, min_rows).select(
        "route_name", "price_elasticity"
    )
    return shaped.join(elasticity, "route_name", "left").select(
        "route_name",
        *_MEANS,
        rounded_mean(F.col("price_elasticity")).alias("price_elasticity"),
        "seasonal_index",
        "sample_count",
    )


def overall_stats(df: DataFrame) -> DataFrame:
    """Three means rounded to 2, routes, rows and date range, in one row."""
    return df.agg(
        *[rounded_mean(F.avg(source)).alias(name) for name, source in _MEANS.items()],
        F.count_distinct("route_name").alias("total_routes"),
        F.count(F.lit(1)).alias("total_samples"),
        F.date_format(F.min("date"), "yyyy-MM-dd").alias("date_start"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("date_end"),
    )
