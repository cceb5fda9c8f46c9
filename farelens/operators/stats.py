"""Statistics of the whole table and of routes.

Groups are formed with partial aggregation before the shuffle, so a route's share of the rows does not
matter. Rows without a route form no group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farelens.fixed_values import IQR_REACH
from farelens.functions import ratio, weekday_label
from farelens.operators.quantiles import exact_quantiles

#: Size of a distinct-count sketch: two to this power counters.
DISTINCT_BITS = 14

STAT_MEANS = ("load_factor", "avg_ticket_price", "profit_rate", "marginal_contribution_rate")


def _by_route(df: DataFrame, *more: str):
    return df.filter(F.col("route_name").isNotNull()).groupBy("route_name", *more)


def overview(df: DataFrame, exact: bool = True) -> DataFrame:
    """Rows, columns, distinct routes and flight numbers, first and last flight date.

    Rows are collapsed to (route, flight number) pairs first: two distinct counts side by side would
    triple every row. ``exact=False`` counts routes and flight numbers by sketches in one aggregation without that shuffle: their standard
    error is 1.04 / sqrt(2 ** DISTINCT_BITS), 0.8 percent.
    """
    if not exact:
        return df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.lit(len(df.columns)).cast("long").alias("n_columns"),
            *[
                F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(DISTINCT_BITS))), F.lit(0)).alias(name)
                for c, name in (("route_name", "n_routes"), ("flight_number", "n_flight_numbers"))
            ],
            F.min("flight_date").alias("first_date"),
            F.max("flight_date").alias("last_date"),
        )
    pairs = df.groupBy("route_name", "flight_number").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("flight_date").alias("first_date"),
        F.max("flight_date").alias("last_date"),
    )
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.count_distinct("route_name").alias("n_routes"),
        F.count_distinct("flight_number").alias("n_flight_numbers"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )


def overall_means(df: DataFrame) -> DataFrame:
    """Means of load factor, price, profit rate and marginal contribution rate."""
    return df.agg(*[F.avg(c).alias(c) for c in STAT_MEANS])


def route_stats(df: DataFrame, measures: Sequence[str] | None = None) -> DataFrame:
    """Means, revenue and profit sums and flights per route, best profit rate first.

    ``measures`` names columns for the short form, which holds only their means.
    """
    means = [F.avg(c).alias(c) for c in (measures or STAT_MEANS)]
    if measures:
        return _by_route(df).agg(*means).orderBy("route_name")
    return (
        _by_route(df)
        .agg(
            *means,
            F.sum("total_revenue").alias("total_revenue"),
            F.sum("profit").alias("profit"),
            F.count("flight_id").alias("flight_count"),
        )
        .orderBy(F.desc("profit_rate"), "route_name")
    )


def load_price_corr(df: DataFrame, price: str = "avg_ticket_price") -> DataFrame:
    """Pearson correlation of load factor and price over rows that have both.

    Null where one of them does not vary; the built-in function raises there in ANSI mode.
    """
    pairs = df.filter(F.col("load_factor").isNotNull() & F.col(price).isNotNull())
    spread = F.stddev_pop("load_factor") * F.stddev_pop(price)
    return pairs.agg(ratio(F.covar_pop("load_factor", price), spread).alias("load_price_corr"))


def load_price_trend(df: DataFrame, price: str = "ticket_price") -> DataFrame:
    """Least-squares line of price on load in percent; null without variation."""
    load = F.col("load_factor") * F.lit(100.0)
    return df.agg(
        F.regr_slope(F.col(price), load).alias("slope"),
        F.regr_intercept(F.col(price), load).alias("intercept"),
    )


def fitted_line(df: DataFrame, price: str = "ticket_price") -> DataFrame:
    """Points of the trend line at every load that occurs, with the number of flights there."""
    line = load_price_trend(df, price).select(F.struct("slope", "intercept").alias("line"))
    return (
        df.select((F.col("load_factor") * F.lit(100.0)).alias("load_pct"))
        .filter(F.col("load_pct").isNotNull())
        .groupBy("load_pct")
        .agg(F.count(F.lit(1)).alias("flights"))
        .withColumn("_line", line.scalar())
        .select(
            "load_pct",
            "flights",
            (F.col("_line.intercept") + F.col("_line.slope") * F.col("load_pct")).alias(
                "fitted_price"
            ),
        )
    )


def profit_by_route(df: DataFrame, margin: str = "profit_margin", ascending: bool = False) -> DataFrame:
    """Mean margin per route in percent, highest first unless ``ascending``."""
    means = _by_route(df).agg((F.avg(margin) * F.lit(100.0)).alias("profit_pct"))
    order = F.asc("profit_pct") if ascending else F.desc("profit_pct")
    return means.orderBy(order, "route_name")


def revenue_cost_by_route(df: DataFrame) -> DataFrame:
    """Mean revenue, mean cost and their difference per route, largest difference first.

    Revenue is ``total_revenue``, else ``revenue``. Without revenue or cost the table is empty.
    """
    revenue = next((c for c in ("total_revenue", "revenue") if c in df.columns), None)
    if revenue is None or "total_cost" not in df.columns:
        return df.sparkSession.createDataFrame(
            [],
            "route_name STRING, avg_revenue DOUBLE, avg_cost DOUBLE, avg_profit DOUBLE",
        )
    return (
        _by_route(df)
        .agg(F.avg(revenue).alias("avg_revenue"), F.avg("total_cost").alias("avg_cost"))
        .withColumn("avg_profit", F.col("avg_revenue") - F.col("avg_cost"))
        .orderBy(F.desc("avg_profit"), "route_name")
    )


def weekday_load(df: DataFrame) -> DataFrame:
    """Mean load factor per weekday 1..7, with the weekday's name."""
    return (
        df.filter(F.col("day_of_week").isNotNull())
        .groupBy("day_of_week")
        .agg(F.avg("load_factor").alias("avg_load_factor"))
        .withColumn("day_name", weekday_label(F.col("day_of_week")))
        .orderBy("day_of_week")
    )


def routes(df: DataFrame) -> DataFrame:
    """Distinct routes in order."""
    return (
        df.filter(F.col("route_name").isNotNull())
        .select("route_name")
        .distinct()
        .orderBy("route_name")
    )


def report_kpis(df: DataFrame) -> DataFrame:
    """Mean load and margin in percent, number of routes and of flights."""
    return df.agg(
        (F.avg("load_factor") * F.lit(100.0)).alias("avg_load_factor"),
        (F.avg("profit_margin") * F.lit(100.0)).alias("avg_profit_margin"),
        F.count_distinct("route_name").alias("total_routes"),
        F.count(F.lit(1)).alias("total_samples"),
    )


def monthly_seasonal_index(df: DataFrame) -> DataFrame:
    """Mean price of each month over the mean price of all flights.

    The grand total comes from the twelve monthly sums, so the flights are read once. The month is derived
    from ``flight_date`` where it is missing; without either the table is empty.
    """
    if "month" not in df.columns:
        if "flight_date" not in df.columns:
            return df.sparkSession.createDataFrame([], "month INT, seasonal_index DOUBLE")
        df = df.withColumn("month", F.month("flight_date"))
    monthly = df.groupBy("month").agg(
        F.sum("ticket_price").alias("price_sum"), F.count("ticket_price").alias("price_n")
    )
    # At most thirteen rows reach this window.
    whole = Window.partitionBy()
    overall = ratio(F.sum("price_sum").over(whole), F.sum("price_n").over(whole))
    return (
        monthly.withColumn(
            "seasonal_index", ratio(ratio(F.col("price_sum"), F.col("price_n")), overall)
        )
        .filter(F.col("month").isNotNull())
        .select("month", "seasonal_index")
        .orderBy("month")
    )


def route_seasonal_index(df: DataFrame) -> DataFrame:
    """Mean price of a route's month over the route's mean price.

    One aggregation to (route, month); the route's mean is rolled up from those few rows.
    """
    monthly = _by_route(df, "month").agg(
        F.sum("ticket_price").alias("price_sum"), F.count("ticket_price").alias("price_n")
    )
    # At most thirteen rows per route.
    route = Window.partitionBy("route_name")
    overall = ratio(F.sum("price_sum").over(route), F.sum("price_n").over(route))
    return (
        monthly.withColumn(
            "seasonal_index", ratio(ratio(F.col("price_sum"), F.col("price_n")), overall)
        )
        .filter(F.col("month").isNotNull())
        .select("route_name", "month", "seasonal_index")
    )


def seasonal_fallback(df: DataFrame) -> DataFrame:
    """Season map for tables without months: the mean supplied index, else 1.0."""
    supplied = "seasonal_index" in df.columns
    value = F.avg("seasonal_index") if supplied else F.lit(1.0)
    return _by_route(df).agg(
        F.create_map(F.lit("avg"), value).alias("seasonal_index"),
        F.count(F.lit(1)).alias("sample_count"),
    )


def price_box_stats(
    df: DataFrame,
    price: str = "avg_ticket_price",
    exact: bool = True,
) -> DataFrame:
    """Box-plot figures of price per route: quartiles, whiskers and the number of outliers.

    Whiskers end at the furthest price within 1.5 interquartile ranges of the box.
    """
    priced = df.filter(F.col("route_name").isNotNull() & F.col(price).isNotNull()).select(
        "route_name", F.col(price).alias("price")
    )
    quartiles = exact_quantiles(priced, ["price"], [0.25, 0.5, 0.75], ["route_name"], exact)
    boxes = quartiles.select(
        "route_name",
        F.col("price")[0].alias("q1"),
        F.col("price")[1].alias("median"),
        F.col("price")[2].alias("q3"),
    )
    reach = (F.col("q3") - F.col("q1")) * F.lit(IQR_REACH)
    above = F.col("price") >= F.col("q1") - reach
    below = F.col("price") <= F.col("q3") + reach
    return (
        priced.join(boxes, "route_name")
        .groupBy("route_name", "q1", "median", "q3")
        .agg(
            F.min(F.when(above, F.col("price"))).alias("whisker_low"),
            F.max(F.when(below, F.col("price"))).alias("whisker_high"),
            F.count_if(~above | ~below).alias("outliers"),
            F.count(F.lit(1)).alias("flights"),
        )
        # A whisker never ends inside the box.
        .withColumn("whisker_low", F.least("whisker_low", "q1"))
        .withColumn("whisker_high", F.greatest("whisker_high", "q3"))
    )


def scatter_points(
    df: DataFrame, price: str = "ticket_price", max_per_route: int | None = None, key: str = "flight_id"
) -> DataFrame:
    """Load in percent against price, one point per flight, or for ``max_per_route`` flights of each route.

    Those are the flights with the smallest hashes of ``key``, then the smallest keys, loads and prices: the same ones in every run. Every
    task cuts its own rows of a route to that number before they are shuffled, so a hot route moves that many rows a task.
    """
    points = ("route_name", (F.col("load_factor") * F.lit(100.0)).alias("load_pct"), F.col(price).alias("price"))
    if max_per_route is None:
        return df.select(*points)
    order = Window.partitionBy("route_name").orderBy(F.md5(F.col(key).cast("string")), key, "load_pct", "price")
    drawn = df.select(*points, key).withColumn("_place", F.row_number().over(order))
    return drawn.filter(F.col("_place") <= max_per_route).drop("_place", key)


def margin_scatter(df: DataFrame) -> DataFrame:
    """Load factor against marginal contribution rate, one point per flight."""
    return df.select("route_name", "load_factor", "marginal_contribution_rate")


def scatter_bins(df: DataFrame, x: str, y: str, x_step: float, y_step: float) -> DataFrame:
    """Chart table of any size of input: flights per route and bin of ``x`` and ``y``, a bin named by its lower edges.

    Flights without one of the two figures take no part.
    """
    placed = df.filter(F.col("route_name").isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    bins = [F.floor(F.col(c) / F.lit(step)).alias(f"{c}_bin") for c, step in ((x, x_step), (y, y_step))]
    return placed.groupBy("route_name", *bins).agg(F.count(F.lit(1)).alias("flights"))


def load_price_bins(df: DataFrame, price: str = "ticket_price", price_step: float = 100.0) -> DataFrame:
    """Load in percent against price, counted in bins of 5 percent and ``price_step``."""
    return scatter_bins(scatter_points(df, price), "load_pct", "price", 5.0, price_step)


def load_margin_bins(df: DataFrame) -> DataFrame:
    """Load factor against marginal contribution rate, counted in bins of 0.05."""
    return scatter_bins(margin_scatter(df), "load_factor", "marginal_contribution_rate", 0.05, 0.05)
