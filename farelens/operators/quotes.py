"""Price quotes for flight requests, one row per request.

Row-wise and stateless, so the same functions price a batch of requests or a stream of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens import fixed_values as fixed
from farelens.functions import clamp


def _levels(col: Column, high, low, middle, part: int) -> Column:
    """Value above the high threshold, below the low one, or between; ``part`` 0 factor, 1 reason."""
    return (
        F.when(col > high[0], F.lit(high[1 + part]))
        .when(col < low[0], F.lit(low[1 + part]))
        .otherwise(F.lit(middle[part]))
    )


def _holiday(part: int) -> Column:
    return F.when(F.col("is_holiday"), F.lit(fixed.QUOTE_HOLIDAY[part])).otherwise(
        F.lit(fixed.QUOTE_NO_HOLIDAY[part])
    )


def _weekday(part: int) -> Column:
    day = F.col("day_of_week")
    return (
        F.when(day.isin(*fixed.QUOTE_NEAR_WEEKEND_DAYS), F.lit(fixed.QUOTE_NEAR_WEEKEND[part]))
        .when(day.isin(*fixed.QUOTE_PEAK_DAYS), F.lit(fixed.QUOTE_PEAK[part]))
        .otherwise(F.lit(fixed.QUOTE_WORKDAY[part]))
    )


def _load(part: int) -> Column:
    return _levels(
        F.col("load_factor"),
        fixed.QUOTE_LOAD_HIGH,
        fixed.QUOTE_LOAD_LOW,
        fixed.QUOTE_LOAD_ELSE,
        part,
    )


def _rival(part: int) -> Column:
    return _levels(
        F.col("competitor_load_factor"),
        fixed.QUOTE_RIVAL_HIGH,
        fixed.QUOTE_RIVAL_LOW,
        fixed.QUOTE_RIVAL_ELSE,
        part,
    )


def _elastic(part: int) -> Column:
    return _levels(
        F.col("price_elasticity"),
        fixed.QUOTE_ELASTIC_HIGH,
        fixed.QUOTE_ELASTIC_LOW,
        fixed.QUOTE_ELASTIC_ELSE,
        part,
    )


def _whole(col: Column) -> Column:
    """Nearest whole number, halves to even."""
    return F.rint(col).cast("long")


def quote_flights(requests: DataFrame) -> DataFrame:
    """Suggested price and its range: the rival's price times six factors, rounded to whole units."""
    factors = (
        _holiday(0) * _weekday(0) * F.col("seasonal_index") * _load(0) * _rival(0) * _elastic(0)
    )
    return (
        requests.withColumn("price_factor", factors)
        .withColumn("suggested_price", _whole(F.col("competitor_price") * F.col("price_factor")))
        .withColumn("price_low", _whole(F.col("suggested_price") * F.lit(0.9)))
        .withColumn("price_high", _whole(F.col("suggested_price") * F.lit(1.1)))
    )


def expected_margin(requests: DataFrame) -> DataFrame:
    """Expected margin range; it follows the load multiplier (0.9, 1.0, 1.1), not the load itself."""
    rate = clamp(F.lit(0.15) + (_load(0) - F.lit(0.8)) * F.lit(0.5), 0.05, 0.3)
    return requests.withColumn("expected_margin", rate).withColumn(
        "expected_margin_high", F.col("expected_margin") + F.lit(0.05)
    )


def quote_ranges(requests: DataFrame) -> DataFrame:
    """Ranges shown with a quote: past price, past load and expected load, in whole units."""
    price = F.col("competitor_price")
    past = F.col("historical_load_factor") * F.lit(100.0)
    load = F.col("load_factor") * F.lit(100.0)
    return requests.withColumns(
        {
            "past_price_low": _whole(price * F.lit(0.95)),
            "past_price_high": _whole(price * F.lit(1.05)),
            "past_load_low": _whole(past),
            "past_load_high": _whole(past + F.lit(5.0)),
            "expected_load_low": _whole(load),
            "expected_load_high": _whole(F.least(F.lit(98.0), load + F.lit(5.0))),
        }
    )


def quote_labels(requests: DataFrame) -> DataFrame:
    """Level words of a request and one reason per price factor."""
    elasticity, season = F.col("price_elasticity"), F.col("seasonal_index")

    def level(words) -> Column:
        return (
            F.when(elasticity > 1.2, F.lit(words[0]))
            .when(elasticity > 0.8, F.lit(words[1]))
            .otherwise(F.lit(words[2]))
        )

    def above(condition: Column) -> Column:
        return F.when(condition, F.lit(fixed.ABOVE)).otherwise(F.lit(fixed.BELOW))

    return requests.withColumns(
        {
            "elasticity_level": level(fixed.ELASTICITY_LEVELS),
            "elasticity_word": level(fixed.ELASTICITY_WORDS),
            "price_sensitivity": level(fixed.PRICE_SENSITIVITY),
            "season_level": above(season > 1),
            "past_load_level": above(F.col("historical_load_factor") > F.col("load_factor")),
            "holiday_reason": _holiday(1),
            "weekday_reason": _weekday(1),
            "season_reason": F.when(
                season > fixed.QUOTE_SEASON_HIGH[0], F.lit(fixed.QUOTE_SEASON_HIGH[1])
            )
            .when(season < fixed.QUOTE_SEASON_LOW[0], F.lit(fixed.QUOTE_SEASON_LOW[1]))
            .otherwise(F.lit(fixed.QUOTE_SEASON_ELSE)),
            "load_reason": _load(1),
            "competition_reason": _rival(1),
            "elasticity_reason": _elastic(1),
        }
    )
