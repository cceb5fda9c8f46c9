"""Rankings, previews and the selection of routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelens.functions import rounded_mean
from farelens.operators.lookup import middle_routes, restrict_routes


def _numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Position 1, 2, ... in the given order; only for tables already cut to a few rows."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def top_bottom(stats: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best and ``k`` worst routes by profit rate.

    Both lists run from better to worse. Each side is a distributed top-k.
    """
    better_first = (F.desc("profit_rate"), F.asc("route_name"))
    worse_first = (F.asc("profit_rate"), F.desc("route_name"))
    shown = stats.select("route_name", "profit_rate", "load_factor", "avg_ticket_price")
    top = _numbered(shown.orderBy(*better_first).limit(k), *better_first)
    bottom = _numbered(shown.orderBy(*worse_first).limit(k), *better_first)
    return top.withColumn("section", F.lit("top")).unionByName(
        bottom.withColumn("section", F.lit("bottom"))
    )


def _best(profile: DataFrame, k: int) -> DataFrame:
    order = (F.desc("profit_margin"), F.asc("route_name"))
    return _numbered(profile.orderBy(*order).limit(k), *order)


def _worst(profile: DataFrame, k: int) -> DataFrame:
    order = (F.asc("profit_margin"), F.asc("route_name"))
    return _numbered(profile.orderBy(*order).limit(k), *order)


def _margins(profile: DataFrame) -> DataFrame:
    return profile.select(
        "route_name", rounded_mean(F.col("avg_profit_margin")).alias("profit_margin")
    )


def best_worst(profile: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best and ``k`` worst routes by margin rounded to 2; ties go by route name in both."""
    margins = _margins(profile)
    return (
        _best(margins, k)
        .withColumn("section", F.lit("best"))
        .unionByName(_worst(margins, k).withColumn("section", F.lit("worst")))
    )


def preview(df: DataFrame, n: int, order_by: Sequence[str | Column]) -> DataFrame:
    """First ``n`` rows in an explicit order; files keep no order of their own."""
    return df.orderBy(*order_by).limit(n)


def sample_routes(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Repeatable sample of ``n`` routes: the first ones in the order of a seeded hash."""
    draw = F.md5(F.concat(F.col("route_name"), F.lit(f"#{seed}")))
    return df.orderBy(draw, "route_name").limit(max(0, n))


def selected_routes(
    profile: DataFrame, max_routes: int = 20, k: int = 3, seed: int = 42
) -> DataFrame:
    """Best, sampled middle and worst routes in that order, cut to ``max_routes`` names.

    The cut falls on the tail of the worst list. A route may appear twice when there are few.
    """
    margins = _margins(profile)
    best, worst = _best(margins, k), _worst(margins, k)
    # With fewer than k routes there is no middle, so the sample size needs no look at the data.
    middle = sample_routes(middle_routes(margins, best, worst), max_routes - 2 * k, seed)
    parts = (
        best.select("route_name", F.lit(1).alias("part"), "position"),
        middle.select("route_name", F.lit(2).alias("part"), F.lit(0).alias("position")),
        worst.select("route_name", F.lit(3).alias("part"), "position"),
    )
    return (
        parts[0]
        .unionByName(parts[1])
        .unionByName(parts[2])
        .orderBy("part", "position", "route_name")
        .limit(max_routes)
        .select("route_name")
    )


def select_routes(
    profile: DataFrame, max_routes: int = 20, k: int = 3, seed: int = 42
) -> DataFrame:
    """Profiles of the selected routes.

    ``profile`` is read by several branches: hand in a written table or one cut with ``cut_lineage``.
    """
    return restrict_routes(profile, selected_routes(profile, max_routes, k, seed))
