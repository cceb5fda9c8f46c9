"""The built-in dimension tables: routes, flight numbers, aircraft, holidays, subsidy tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farelens import fixed_values as fixed


def routes_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(fixed.ROUTES),
        "route_name STRING, departure STRING, arrival STRING, distance INT, base_price INT, "
        "elasticity DOUBLE, seasonal_index DOUBLE, profitability STRING",
    )


def flight_numbers(spark: SparkSession) -> DataFrame:
    rows = [(route, list(numbers)) for route, numbers in fixed.FLIGHT_NUMBERS]
    return spark.createDataFrame(rows, "route_name STRING, flight_numbers ARRAY<STRING>")


def aircraft(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(fixed.AIRCRAFT_SEATS), "aircraft_type STRING, seat_capacity INT"
    )


def holidays(spark: SparkSession) -> DataFrame:
    rows = [(day,) for day in fixed.HOLIDAYS]
    return spark.createDataFrame(rows, "holiday STRING").select(
        F.to_date("holiday").alias("holiday")
    )


def subsidy_tiers(spark: SparkSession) -> DataFrame:
    rows = [(route, "A") for route in fixed.SUBSIDY_ROUTES_A]
    rows += [(route, "B") for route in fixed.SUBSIDY_ROUTES_B]
    return spark.createDataFrame(rows, "route_name STRING, subsidy_tier STRING")
