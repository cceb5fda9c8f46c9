"""Price elasticity of routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelens.fixed_values import MIN_ELASTICITY_ROWS
from farelens.functions import ratio
from farelens.operators.quantiles import ranked_values

_NO_PRICE = float("inf")


def _halves(df: DataFrame, supplied: bool, key: str) -> DataFrame:
    """Elasticity and size of each route, with the mean supplied elasticity if wanted.

    No route is sorted as a whole. The price in the middle of each route is found by counting (``ranked_values``); flights below
    and above it are summed up on the map side, and only those at just this price are ordered, by their seats, as a histogram. One
    route may therefore hold any share of the table: at most one row for each number of seats comes together.
    """
    given = F.col("price_elasticity") if supplied else F.lit(None)
    rows = df.filter(F.col(key).isNotNull()).select(
        key,
        F.col("ticket_price").cast("double").alias("price"),
        F.col("sold_seats").cast("double").alias("seats"),
        # Flights without a price sort last.
        F.coalesce(F.col("ticket_price").cast("double"), F.lit(_NO_PRICE)).alias("value"),
        given.cast("double").alias("given"),
    )
    middle = ranked_values(
        rows.select(key, "value"), [key], lambda size, nulls: F.array(F.greatest(F.floor(size / 2), F.lit(1)).cast("long"))
    ).select(key, "size", F.col("value").alias("middle"))
    at_middle = F.col("value") == F.col("middle")
    zone = F.when(at_middle, 1).when(F.col("value") < F.col("middle"), 0).otherwise(2)
    route = [key, "size"]
    histogram = (
        rows.join(middle, key)
        .groupBy(*route, zone.alias("zone"), F.when(at_middle, F.col("seats")).alias("middle_seats"))
        .agg(
            F.count(F.lit(1)).alias("weight"),
            F.sum("price").alias("price_sum"),
            F.count("price").alias("price_n"),
            F.sum("seats").alias("seats_sum"),
            F.count("seats").alias("seats_n"),
            F.sum("given").alias("given_sum"),
            F.count("given").alias("given_n"),
        )
    )

    order = Window.partitionBy(*route).orderBy("zone", "middle_seats")
    upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    half = F.floor(F.col("size") / 2)
    before = F.col("upto") - F.col("weight")
    # Within one histogram entry all rows are alike, so a share of its sums is exact.
    low_share = F.greatest(F.lit(0), F.least(half - before, F.col("weight"))) / F.col("weight")
    cut = histogram.withColumn("upto", upto).withColumn("low_share", low_share)

    def mean_of(measure: str, share: Column) -> Column:
        return ratio(
            F.sum(F.col(f"{measure}_sum") * share), F.sum(F.col(f"{measure}_n") * share)
        )

    low, high = F.col("low_share"), F.lit(1.0) - F.col("low_share")
    halves = cut.groupBy(*route).agg(
        mean_of("price", low).alias("low_price"),
        mean_of("price", high).alias("high_price"),
        mean_of("seats", low).alias("low_seats"),
        mean_of("seats", high).alias("high_seats"),
        ratio(F.sum("given_sum"), F.sum("given_n")).alias("supplied"),
    )
    price_change = ratio(F.col("high_price") - F.col("low_price"), F.col("low_price"))
    seats_change = ratio(F.col("high_seats") - F.col("low_seats"), F.col("low_seats"))
    return halves.select(*route, "supplied", ratio(seats_change, price_change).alias("computed"))


def price_elasticity(
    df: DataFrame,
    min_rows: int = MIN_ELASTICITY_ROWS,
    key: str = "route_name",
) -> DataFrame:
    """Elasticity between the cheaper and the dearer half of each route's flights.

    Flights are ordered by price, then seats; the cheaper half is the first floor(n/2) of them. The
    result is the relative change of mean seats over the relative change of mean price. It is null for
    routes under ``min_rows`` flights, and where a divisor is zero.
    """
    return _halves(df, False, key).select(
        key,
        F.when(F.col("size") >= min_rows, F.col("computed")).alias("price_elasticity"),
        F.col("size").alias("sample_count"),
    )


def supplied_elasticity(df: DataFrame, key: str = "route_name") -> DataFrame:
    """Mean of a supplied ``price_elasticity`` per route."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.avg("price_elasticity").alias("price_elasticity"))
    )


def elasticity_or_supplied(
    df: DataFrame,
    min_rows: int = MIN_ELASTICITY_ROWS,
    key: str = "route_name",
) -> DataFrame:
    """Computed elasticity, or the mean of the supplied one where it does not apply.

    It does not apply to routes under ``min_rows`` flights and to tables without ``sold_seats``. A large
    route whose figure is null keeps null.
    """
    has_seats, has_supplied = "sold_seats" in df.columns, "price_elasticity" in df.columns
    routes = df.filter(F.col(key).isNotNull())
    if not has_seats:
        value = F.avg("price_elasticity") if has_supplied else F.lit(None).cast("double")
        return routes.groupBy(key).agg(
            value.alias("price_elasticity"), F.count(F.lit(1)).alias("sample_count")
        )
    return _halves(df, has_supplied, key).select(
        key,
        F.when(F.col("size") >= min_rows, F.col("computed"))
        .otherwise(F.col("supplied"))
        .alias("price_elasticity"),
        F.col("size").alias("sample_count"),
    )


def elasticity_rank(elasticities: DataFrame) -> DataFrame:
    """Routes by the size of their elasticity, smallest first; routes without one are dropped."""
    return elasticities.filter(F.col("price_elasticity").isNotNull()).orderBy(
        F.abs("price_elasticity"), "route_name"
    )
