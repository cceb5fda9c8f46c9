"""Explicit schemas: operational flights, flight requests and the nested data summary."""

from __future__ import annotations

from pyspark.sql import types as T

FLIGHT_SCHEMA = T.StructType(
    [
        T.StructField("flight_id", T.LongType()),
        T.StructField("flight_number", T.StringType()),
        T.StructField("departure_city", T.StringType()),
        T.StructField("arrival_city", T.StringType()),
        T.StructField("route_name", T.StringType()),
        T.StructField("flight_date", T.StringType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("is_holiday", T.IntegerType()),
        T.StructField("aircraft_type", T.StringType()),
        T.StructField("seat_capacity", T.IntegerType()),
        T.StructField("booked_seats", T.IntegerType()),
        T.StructField("load_factor", T.DoubleType()),
        T.StructField("flight_hours", T.DoubleType()),
        T.StructField("variable_cost", T.DoubleType()),
        T.StructField("fixed_cost", T.DoubleType()),
        T.StructField("maintenance_cost", T.DoubleType()),
        T.StructField("total_cost", T.DoubleType()),
        T.StructField("passenger_revenue", T.DoubleType()),
        T.StructField("subsidy_revenue", T.DoubleType()),
        T.StructField("total_revenue", T.DoubleType()),
        T.StructField("marginal_contribution", T.DoubleType()),
        T.StructField("marginal_contribution_rate", T.DoubleType()),
        T.StructField("profit", T.DoubleType()),
        T.StructField("profit_rate", T.DoubleType()),
        T.StructField("avg_ticket_price", T.DoubleType()),
        T.StructField("discount_rate", T.DoubleType()),
        T.StructField("rask", T.DoubleType()),
        T.StructField("ask", T.DoubleType()),
        T.StructField("competitor_load_factor", T.DoubleType()),
        T.StructField("competitor_price", T.DoubleType()),
        T.StructField("historical_load_factor", T.DoubleType()),
        T.StructField("seasonal_index", T.DoubleType()),
        T.StructField("price_elasticity", T.DoubleType()),
        T.StructField("optimal_price", T.DoubleType()),
        T.StructField("price_lower_bound", T.DoubleType()),
        T.StructField("price_upper_bound", T.DoubleType()),
    ]
)

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("route", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("is_holiday", T.BooleanType()),
        T.StructField("day_of_week", T.StringType()),
        T.StructField("aircraft_type", T.StringType()),
        T.StructField("seat_capacity", T.IntegerType()),
        T.StructField("price_elasticity", T.DoubleType()),
        T.StructField("seasonal_index", T.DoubleType()),
        T.StructField("load_factor", T.DoubleType()),
        T.StructField("competitor_load_factor", T.DoubleType()),
        T.StructField("historical_load_factor", T.DoubleType()),
        T.StructField("competitor_price", T.IntegerType()),
    ]
)

_RANKED_ROUTE = T.StructType(
    [
        T.StructField("route", T.StringType()),
        T.StructField("profit_margin", T.DoubleType()),
    ]
)

ROUTE_PROFILE = T.StructType(
    [
        T.StructField("avg_price", T.DoubleType()),
        T.StructField("avg_load_factor", T.DoubleType()),
        T.StructField("avg_profit_margin", T.DoubleType()),
        T.StructField("price_elasticity", T.DoubleType()),
        T.StructField("seasonal_index", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("sample_count", T.LongType()),
    ]
)

# sample_data is left out: nothing reads it back.
SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField(
            "overall_stats",
            T.StructType(
                [
                    T.StructField("avg_price", T.DoubleType()),
                    T.StructField("avg_load_factor", T.DoubleType()),
                    T.StructField("avg_profit_margin", T.DoubleType()),
                    T.StructField("total_routes", T.LongType()),
                    T.StructField("total_samples", T.LongType()),
                    T.StructField(
                        "date_range",
                        T.StructType(
                            [
                                T.StructField("start", T.StringType()),
                                T.StructField("end", T.StringType()),
                            ]
                        ),
                    ),
                ]
            ),
        ),
        T.StructField("best_performing_routes", T.ArrayType(_RANKED_ROUTE)),
        T.StructField("worst_performing_routes", T.ArrayType(_RANKED_ROUTE)),
        T.StructField("route_stats", T.MapType(T.StringType(), ROUTE_PROFILE)),
    ]
)
