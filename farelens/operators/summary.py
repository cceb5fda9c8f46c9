"""The nested data summary: overall figures, ranked routes, route profiles and sample rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farelens.operators.profile import overall_stats
from farelens.operators.rank import best_worst, preview, select_routes

SAMPLE_ROWS = 10

_PROFILE = (
    "avg_price",
    "avg_load_factor",
    "avg_profit_margin",
    "price_elasticity",
    "seasonal_index",
    "sample_count",
)


def _listed(rows: DataFrame, item: Column, order: str) -> Column:
    """Scalar array of a few rows, in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), item.alias("item"))))
    return rows.agg(F.transform(pairs, lambda p: p["item"]).alias("rows")).scalar()


def _ranked(profile: DataFrame, section: str, k: int) -> Column:
    rows = best_worst(profile, k).filter(F.col("section") == section)
    return _listed(
        rows, F.struct(F.col("route_name").alias("route"), "profit_margin"), "position"
    )


def _profile_map(profile: DataFrame) -> Column:
    """Scalar map of route -> profile, in route order."""
    # Maps cannot be sorted, so the season travels as entries until the routes are in order.
    season = F.map_entries("seasonal_index").alias("seasonal_index")
    value = F.struct(*[season if c == "seasonal_index" else F.col(c) for c in _PROFILE])
    listed = profile.agg(F.array_sort(F.collect_list(F.struct("route_name", value.alias("profile")))).alias("r"))

    def entry(item: Column) -> Column:
        fields = [
            F.map_from_entries(item["profile"][c]).alias(c)
            if c == "seasonal_index"
            else item["profile"][c].alias(c)
            for c in _PROFILE
        ]
        return F.struct(item["route_name"].alias("key"), F.struct(*fields).alias("value"))

    return listed.select(F.map_from_entries(F.transform("r", entry)).alias("m")).scalar()


def _summary(df: DataFrame, ranked: DataFrame, listed: DataFrame, k: int) -> DataFrame:
    overall = overall_stats(df).select(
        F.struct(
            "avg_price",
            "avg_load_factor",
            "avg_profit_margin",
            "total_routes",
            "total_samples",
            F.struct(F.col("date_start").alias("start"), F.col("date_end").alias("end")).alias(
                "date_range"
            ),
        ).alias("overall_stats")
    )
    return overall.withColumns(
        {
            "best_performing_routes": _ranked(ranked, "best", k),
            "worst_performing_routes": _ranked(ranked, "worst", k),
            "route_stats": _profile_map(listed),
        }
    )


def data_summary(
    df: DataFrame,
    profile: DataFrame,
    sample_order: Sequence[str],
    k: int = 3,
) -> DataFrame:
    """One nested row: overall figures, best and worst routes, all profiles, first sample rows.

    ``df`` is the cleaned table and ``profile`` its route profiles, as a written table: several branches read it. The row names
    every route, as one JSON document has to; ``summary_rows`` has the same in a row for each route, for networks of any size.
    """
    sample = preview(df, SAMPLE_ROWS, sample_order)
    key = F.struct(*sample_order)
    rows = sample.select(key.alias("_key"), F.struct(*df.columns).alias("_row"))
    return _summary(df, profile, profile, k).withColumn(
        "sample_data", _listed(rows, F.col("_row"), "_key")
    )


_JSON = {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd"}


def summary_document(df: DataFrame, profile: DataFrame, sample_order: Sequence[str], k: int = 3) -> DataFrame:
    """The data summary of any number of routes as lines (section, route_name, line) of one JSON text.

    Line 0 opens the document with the overall figures and the best and worst routes, then comes a line for each route by name, and
    the last line closes it with the sample rows. In the order of section and route the lines are the same text that
    ``to_summary_json`` makes of ``data_summary``. No task and no row holds more than one route.
    """
    empty = profile.limit(0)
    head = _summary(df, profile, empty, k).drop("route_stats")
    opened = F.to_json(F.struct(*head.columns), _JSON)
    first = head.select(
        F.lit(0).alias("section"),
        F.lit(None).cast("string").alias("route_name"),
        F.concat(F.substring(opened, F.lit(1), F.length(opened) - 1), F.lit(',"route_stats":{')).alias("line"),
    )
    entry = F.to_json(F.create_map("route_name", F.struct(*_PROFILE)), _JSON)
    least = profile.agg(F.min("route_name").alias("least")).scalar()
    comma = F.when(F.col("route_name") == least, "").otherwise(",")
    routes = profile.select(
        F.lit(1).alias("section"), "route_name", F.concat(comma, F.substring(entry, F.lit(2), F.length(entry) - 2)).alias("line")
    )
    sample = preview(df, SAMPLE_ROWS, sample_order).select(F.struct(*sample_order).alias("_key"), F.struct(*df.columns).alias("_row"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col("_key").alias("at"), F.col("_row").alias("item")))), lambda p: p["item"])
    last = sample.agg(F.to_json(rows, _JSON).alias("rows")).select(
        F.lit(2).alias("section"),
        F.lit(None).cast("string").alias("route_name"),
        F.concat(F.lit('},"sample_data":'), F.col("rows"), F.lit("}")).alias("line"),
    )
    return first.unionByName(routes).unionByName(last)


def simplify(
    df: DataFrame,
    profile: DataFrame,
    max_routes: int = 20,
    keep_all: bool = False,
    k: int = 3,
    seed: int = 42,
) -> DataFrame:
    """Summary without sample rows, with all profiles (``keep_all``) or those of at most ``max_routes`` routes."""
    listed = profile if keep_all else select_routes(profile, max_routes, k, seed)
    return _summary(df, profile, listed, k)


def _quoted(text: Column) -> Column:
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def indented_json(col: Column, kind: T.DataType, depth: int = 0) -> Column:
    """JSON text with an indent of two, ``"key": value`` and every list item on a line of its own."""
    inside, end = "\n" + "  " * (depth + 1), "\n" + "  " * depth
    if isinstance(kind, T.StructType):
        parts = [
            F.concat(F.lit(f'{inside}"{f.name}": '), indented_json(col[f.name], f.dataType, depth + 1)) for f in kind.fields
        ]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit(end + "}"))
    elif isinstance(kind, T.ArrayType):
        items = F.transform(col, lambda x: F.concat(F.lit(inside), indented_json(x, kind.elementType, depth + 1)))
        text = F.when(F.size(col) == 0, "[]").otherwise(F.concat(F.lit("["), F.array_join(items, ","), F.lit(end + "]")))
    elif isinstance(kind, T.MapType):
        items = F.transform(
            F.map_entries(col),
            lambda e: F.concat(F.lit(inside), _quoted(e["key"]), F.lit(": "), indented_json(e["value"], kind.valueType, depth + 1)),
        )
        text = F.when(F.size(col) == 0, "{}").otherwise(F.concat(F.lit("{"), F.array_join(items, ","), F.lit(end + "}")))
    elif isinstance(kind, T.StringType):
        text = _quoted(col)
    elif isinstance(kind, (T.DateType, T.TimestampType)):
        text = F.concat(F.lit('"'), F.date_format(col, "yyyy-MM-dd"), F.lit('"'))
    else:
        text = col.cast("string")
    return F.coalesce(F.when(col.isNotNull(), text), F.lit("null"))


def to_summary_json(summary: DataFrame, pretty: bool = False) -> DataFrame:
    """Summary rows as JSON text: dates as text, missing figures as ``null``, non-ASCII kept; ``pretty``: indented by two."""
    whole = F.struct(*summary.columns)
    if pretty:
        return summary.select(indented_json(whole, summary.schema).alias("summary_json"))
    return summary.select(F.to_json(whole, _JSON).alias("summary_json"))


def route_summary_rows(profile: DataFrame) -> DataFrame:
    """Route profiles as one JSON text per route, for networks of any size."""
    fields = F.struct(*_PROFILE)
    return profile.select(
        "route_name", F.to_json(fields, {"ignoreNullFields": "false"}).alias("profile_json")
    )


def summary_rows(df: DataFrame, profile: DataFrame) -> DataFrame:
    """Summary of all routes in rows (section, route_name, summary_json): one overall row, and one for each route."""
    overall = overall_stats(df)
    text = F.to_json(F.struct(*overall.columns), {"ignoreNullFields": "false"})
    first = overall.select(F.lit("overall").alias("section"), F.lit(None).cast("string").alias("route_name"), text.alias("summary_json"))
    routes = route_summary_rows(profile).select(F.lit("route").alias("section"), "route_name", F.col("profile_json").alias("summary_json"))
    return first.unionByName(routes)
