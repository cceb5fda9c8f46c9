"""Flight economics: demand, cost, load, price, revenue and profit as column formulas.

All steps are row-wise and stateless, so they take batch and streaming tables alike. Money is in units of
10,000 except ticket prices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens import fixed_values as fixed
from farelens.functions import clamp, clamp_load, ratio_or_zero, rounded


def _tier_factor(pairs: tuple[tuple[str, float], ...]) -> Column:
    """Factor of the profitability tier; the last entry serves every other tier."""
    *named, (_, last) = pairs
    factor = F.when(F.col("profitability") == named[0][0], F.lit(named[0][1]))
    for tier, value in named[1:]:
        factor = factor.when(F.col("profitability") == tier, F.lit(value))
    return factor.otherwise(F.lit(last))


def _group_factor(col: Column, groups) -> Column:
    factor = F.when(col.isin(*groups[0][0]), F.lit(groups[0][1]))
    for members, value in groups[1:]:
        factor = factor.when(col.isin(*members), F.lit(value))
    return factor.otherwise(F.lit(1.0))


def season_factor(month: Column) -> Column:
    return _group_factor(month, fixed.SEASON_FACTORS)


def season_adjust(df: DataFrame) -> DataFrame:
    """Route's seasonal index times the factor of the flight's month."""
    return df.withColumn(
        "adjusted_seasonal_index",
        F.col("seasonal_index") * season_factor(F.month("flight_date")),
    )


def demand_factors(df: DataFrame) -> DataFrame:
    """Demand factors of the weekday (1 = Monday) and of holidays."""
    return df.withColumns(
        {
            "day_factor": _group_factor(F.col("day_of_week"), fixed.DAY_FACTORS),
            "holiday_factor": F.when(
                F.col("is_holiday") == 1, F.lit(fixed.HOLIDAY_DEMAND_FACTOR)
            ).otherwise(F.lit(1.0)),
        }
    )


def flight_hours(distance: Column) -> Column:
    return rounded(distance / F.lit(fixed.CRUISE_KM_PER_HOUR), 2)


def flight_cost(df: DataFrame) -> DataFrame:
    """Hours and the three cost parts from rates per hour and per flight, and their total."""
    factor = _tier_factor(fixed.TIER_COST_FACTORS)
    hours = F.col("flight_hours")
    return (
        df.withColumn("flight_hours", flight_hours(F.col("distance")))
        .withColumns(
            {
                "variable_cost": rounded(F.col("variable_cost_per_hour") * factor * hours),
                "fixed_cost": rounded(F.col("fixed_cost_per_flight") * factor),
                "maintenance_cost": rounded(F.col("maintenance_per_hour") * hours * factor),
            }
        )
        .withColumn(
            "total_cost",
            rounded(F.col("variable_cost") + F.col("fixed_cost") + F.col("maintenance_cost")),
        )
    )


def load_and_seats(df: DataFrame) -> DataFrame:
    """Load factor from base load and demand factors, and the seats it fills (whole seats only).

    Competitor and historical load follow from it where a ``..._load_shift`` column is present.
    """
    demand = (
        F.col("base_load_factor")
        * F.col("day_factor")
        * F.col("holiday_factor")
        * F.col("adjusted_seasonal_index")
    )
    loaded = df.withColumn("load_factor", clamp(demand, *fixed.LOAD_FACTOR_RANGE)).withColumn(
        "booked_seats", (F.col("seat_capacity") * F.col("load_factor")).cast("int")
    )
    shifted = {
        f"{name}_load_factor": clamp_load(F.col("load_factor") + F.col(f"{name}_load_shift"))
        for name in ("competitor", "historical")
        if f"{name}_load_shift" in df.columns
    }
    return loaded.withColumns(shifted) if shifted else loaded


def discount_band(df: DataFrame) -> DataFrame:
    """Lowest and highest discount rate for the flight's load."""
    (high, *high_band), (middle, *middle_band) = fixed.DISCOUNT_BANDS
    load = F.col("load_factor")

    def edge(i: int) -> Column:
        return (
            F.when(load > high, F.lit(high_band[i]))
            .when(load > middle, F.lit(middle_band[i]))
            .otherwise(F.lit(fixed.DISCOUNT_BAND_ELSE[i]))
        )

    return df.withColumns({"discount_low": edge(0), "discount_high": edge(1)})


def ticket_price(df: DataFrame) -> DataFrame:
    """Average ticket price from base price, discount, season and tier; rounded before and after the tier."""
    season = F.lit(1.0) + (F.col("adjusted_seasonal_index") - F.lit(1.0)) * F.lit(0.5)
    plain = rounded(F.col("base_price") * F.col("discount_rate") * season)
    return df.withColumn(
        "avg_ticket_price", rounded(plain * _tier_factor(fixed.TIER_PRICE_FACTORS))
    )


def revenue(df: DataFrame) -> DataFrame:
    """Passenger revenue, and total revenue with the subsidy."""
    return df.withColumn(
        "passenger_revenue",
        rounded(F.col("avg_ticket_price") * F.col("booked_seats") / F.lit(fixed.MONEY_UNIT)),
    ).withColumn(
        "total_revenue", rounded(F.col("passenger_revenue") + F.col("subsidy_revenue"))
    )


def profitability(df: DataFrame) -> DataFrame:
    """Marginal contribution and profit, with their rates; a rate is 0 without revenue."""
    total = F.col("total_revenue")
    return df.withColumns(
        {
            "marginal_contribution": rounded(total - F.col("variable_cost")),
            "profit": rounded(total - F.col("total_cost")),
        }
    ).withColumns(
        {
            "marginal_contribution_rate": rounded(
                ratio_or_zero(F.col("marginal_contribution"), total), 4
            ),
            "profit_rate": rounded(ratio_or_zero(F.col("profit"), total), 4),
        }
    )


def margin(df: DataFrame) -> DataFrame:
    """Profit and margin from the analytic ``revenue`` and ``total_cost``; not rounded."""
    return df.withColumn("profit", F.col("revenue") - F.col("total_cost")).withColumn(
        "profit_margin", ratio_or_zero(F.col("profit"), F.col("revenue"))
    )


def unit_revenue(df: DataFrame) -> DataFrame:
    """Available seat kilometres, and revenue per available seat kilometre."""
    return df.withColumn(
        "ask",
        rounded(F.col("seat_capacity") * F.col("distance") / F.lit(fixed.MONEY_UNIT)),
    ).withColumn("rask", rounded(ratio_or_zero(F.col("total_revenue"), F.col("ask")), 4))


def price_bounds(df: DataFrame) -> DataFrame:
    """Lower bound covers variable cost at 70 % load; upper bound is 1.2 times the base price."""
    return df.withColumns(
        {
            "price_lower_bound": rounded(
                F.try_divide(
                    F.col("variable_cost") * F.lit(fixed.MONEY_UNIT),
                    F.col("seat_capacity") * F.lit(0.7),
                )
            ),
            "price_upper_bound": rounded(F.col("base_price") * F.lit(1.2)),
        }
    )


def optimal_price(df: DataFrame) -> DataFrame:
    """Raise by 10 % at high load and lower by 10 % at low load, within the price bounds."""
    load, price = F.col("load_factor"), F.col("avg_ticket_price")
    target = (
        F.when(
            load > fixed.HIGH_LOAD, F.least(F.col("price_upper_bound"), price * F.lit(1.1))
        )
        .when(load < fixed.LOW_LOAD, F.greatest(F.col("price_lower_bound"), price * F.lit(0.9)))
        .otherwise(price)
    )
    return df.withColumn("optimal_price", rounded(target))


def flight_economics(df: DataFrame) -> DataFrame:
    """All steps in order on a flight plan with its rates, capacity, discount and subsidy."""
    steps = (
        season_adjust,
        demand_factors,
        flight_cost,
        load_and_seats,
        discount_band,
        ticket_price,
        revenue,
        profitability,
        unit_revenue,
        price_bounds,
        optimal_price,
    )
    for step in steps:
        df = df.transform(step)
    return df
