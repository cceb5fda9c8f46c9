"""Lookups of dimension values and membership tests, as joins.

No join carries a broadcast hint of its own: Spark broadcasts a side whose size it has checked against
``spark.sql.autoBroadcastJoinThreshold``, and beyond that falls back to a shuffled join, where adaptive
execution splits hot routes. Only a side that a caller has passed through ``sent_whole`` is marked, after its size was counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.fixed_values import SUBSIDY_RANGES

#: Bytes of texts up to which ``sent_whole`` marks a table.
SENT_BYTES = 128 << 20


def with_route_attrs(df: DataFrame, routes: DataFrame) -> DataFrame:
    """Distance, base price, elasticity, season and tier of the flight's route; null if unknown."""
    return df.join(routes, "route_name", "left")


def with_capacity(df: DataFrame, aircraft: DataFrame) -> DataFrame:
    """Seat capacity of the flight's aircraft type; null if unknown."""
    return df.join(aircraft, "aircraft_type", "left")


def with_holiday_flag(df: DataFrame, holidays: DataFrame) -> DataFrame:
    """``is_holiday`` 1 for flights on a holiday, else 0; repeated holidays do not repeat flights."""
    days = holidays.select(F.col("holiday").cast("date").alias("_holiday")).distinct()
    same_day = F.col("flight_date").cast("date") == F.col("_holiday")
    return (
        df.join(days, same_day, "left")
        .withColumn("is_holiday", F.when(F.col("_holiday").isNotNull(), 1).otherwise(0))
        .drop("_holiday")
    )


def with_subsidy_tier(df: DataFrame, tiers: DataFrame) -> DataFrame:
    """Subsidy tier of the route with its range per flight; ``none`` and 0 outside the lists."""
    joined = df.join(tiers.select("route_name", "subsidy_tier"), "route_name", "left")

    def edge(position: int):
        value = F.lit(0.0)
        for tier in reversed(SUBSIDY_RANGES):
            value = F.when(F.col("subsidy_tier") == tier[0], F.lit(tier[position])).otherwise(value)
        return value

    return joined.withColumns({"subsidy_low": edge(1), "subsidy_high": edge(2)}).withColumn(
        "subsidy_tier", F.coalesce("subsidy_tier", F.lit("none"))
    )


def restrict_routes(stats: DataFrame, selected: DataFrame) -> DataFrame:
    """Statistics of the selected routes only."""
    return stats.join(selected.select("route_name"), "route_name", "left_semi")


def middle_routes(stats: DataFrame, best: DataFrame, worst: DataFrame) -> DataFrame:
    """Routes that are neither among the best nor among the worst."""
    taken = best.select("route_name").unionByName(worst.select("route_name"))
    return stats.join(taken, "route_name", "left_anti")


def route_flight_pairs(df: DataFrame) -> DataFrame:
    """Distinct (route, flight number) pairs, one per row."""
    return (
        df.filter(F.col("route_name").isNotNull() & F.col("flight_number").isNotNull())
        .select("route_name", "flight_number")
        .distinct()
    )


def route_flight_numbers(df: DataFrame) -> DataFrame:
    """Flight numbers in use per route, as a sorted list.

    Pairs are made distinct first, so a list is as long as the route's timetable, not its history.
    ``route_flight_pairs`` holds the same as rows.
    """
    return (
        route_flight_pairs(df)
        .groupBy("route_name")
        .agg(F.array_sort(F.collect_list("flight_number")).alias("flight_numbers"))
    )


def sent_whole(table: DataFrame) -> DataFrame:
    """A written table of one row for each key, marked to be broadcast if its texts hold ``SENT_BYTES`` at most.

    A shuffled join makes a new copy of each row that it puts out, a broadcast one fills the same row again, which is what long
    texts cost. The texts are counted here, in one pass.
    """
    texts = [name for name, kind in table.dtypes if kind == "string"]
    size = table.select(sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in texts), F.lit(0).cast("long")).alias("n"))
    return F.broadcast(table) if (size.agg(F.sum("n")).first()[0] or 0) <= SENT_BYTES else table


def with_flight_numbers(df: DataFrame, lists: DataFrame) -> DataFrame:
    """Column ``flight_numbers`` of each row's route, null for a route without; ``lists``: (route_name, flight_numbers)."""
    return df.join(lists.select("route_name", "flight_numbers"), "route_name", "left")
