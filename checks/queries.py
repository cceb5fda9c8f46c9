"""One registered query per operator, each over whole tables.

Figures that depend on the order of summation are rounded here, so that they compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from farelens.fixed_values import IQR_COLUMNS
from farelens.functions import rounded_mean
from farelens.operators import (
    clean,
    economics,
    elasticity,
    lookup,
    profile,
    prompts,
    quotes,
    rank,
    report,
    responses,
    rules,
    states,
    stats,
    summary,
)
from farelens.plans import pricing_summary, route_report
from farelens.sources import (
    FlightScan,
    cut_lineage,
    new_folder,
    read_document_routes,
    read_flights,
    scan_flights,
    write_csv,
    write_document,
)


def rounded_columns(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: rounded_mean(F.col(c), digits) for c in names})


def _map_text(entries: Column) -> Column:
    """Season map as ``key:value`` pairs."""
    return F.array_join(
        F.transform(
            F.map_entries(entries),
            lambda e: F.format_string("%s:%.2f", e["key"], e["value"]),
        ),
        ";",
    )


# --- sources and sinks --------------------------------------------------------------------------


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights to CSV and back, then their route statistics to CSV and back."""
    flights_path = new_folder(fx.work_folder(spark), "flights-csv")
    write_csv(fx.flights(spark, sf_dir), flights_path, "gzip")
    route_stats = stats.route_stats(read_flights(spark, flights_path))
    stats_path = new_folder(fx.work_folder(spark), "route-stats-csv")
    write_csv(route_stats, stats_path)
    schema = route_stats.schema
    back = read_flights(spark, stats_path, schema)
    return rounded_columns(back, *_STATS)


#: What route profiles are made of, and what a summary shows as samples.
_PROFILED = ("route_name", "month", "ticket_price", "load_factor", "profit_margin", "sold_seats", "price_elasticity", "seasonal_index")
_SAMPLED = (
    "date",
    "route_name",
    "flight_number",
    "flight_id",
    "total_revenue",
    "total_cost",
    "ticket_price",
    "load_factor",
    "profit_margin",
    "month",
)


def _kept(spark: SparkSession, flights: DataFrame, *names: str, order: str | None = None) -> DataFrame:
    """These columns of the flights, written once: an operator of several passes would run the joins behind the flights in each.

    With ``order`` the rows of each file are in the order of that column.
    """
    flights = flights.select(*dict.fromkeys(names))
    return cut_lineage(flights.sortWithinPartitions(order) if order else flights, fx.work_folder(spark))


def _analytic(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return _kept(spark, fx.analytic(spark, sf_dir), *names)


def _profile(spark: SparkSession, flights: DataFrame) -> DataFrame:
    """Route profiles, cut because rankings and selections read them several times."""
    return cut_lineage(profile.route_profile(flights.select(*_PROFILED)), fx.work_folder(spark))


_BY_NAME = "flight_id BIGINT, route_name STRING, avg_ticket_price DOUBLE, load_factor DOUBLE, booked_seats INT"


def _mixed_files(spark: SparkSession, sf_dir: str) -> FlightScan:
    """Flights in files of two column orders, one kind with a column more; some prices and seats are no numbers."""
    path = new_folder(fx.work_folder(spark), "mixed-csv")
    flight, odd = F.col("flight_id"), F.col("flight_id") % 2
    names = ["flight_id", "route_name", "avg_ticket_price", "load_factor", "booked_seats"]
    rows = fx.flights(spark, sf_dir).select(*names)
    price = F.when(flight % 50 == 0, F.concat(F.lit("bad-"), flight)).otherwise(F.col("avg_ticket_price").cast("string"))
    write_csv(rows.filter(odd == 0).withColumn("avg_ticket_price", price), f"{path}/even")
    seats = F.when(flight % 35 == 1, F.concat(F.lit("many-"), flight)).otherwise(F.col("booked_seats").cast("string"))
    write_csv(rows.filter(odd == 1).withColumn("booked_seats", seats).select(F.lit("x").alias("note"), *reversed(names)), f"{path}/odd")
    return scan_flights(spark, f"{path}/*", _BY_NAME)


def csv_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed_files(spark, sf_dir).rows


def csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed_files(spark, sf_dir).rejects.select(F.col("column").alias("column_name"), "value")


def _document(spark: SparkSession, sf_dir: str) -> DataFrame:
    flights = _analytic(spark, sf_dir, *_SAMPLED, *_PROFILED)
    return summary.summary_document(flights.select(*_SAMPLED), _profile(spark, flights), fx.PREVIEW_ORDER)


def summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of all routes, line by line."""
    return _document(spark, sf_dir)


def summary_elasticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elasticities read back from a written summary document."""
    path = new_folder(fx.work_folder(spark), "summary-document")
    write_document(_document(spark, sf_dir), path)
    read = read_document_routes(spark, path).select("route_name", F.col("profile.price_elasticity").alias("price_elasticity"))
    return read.filter(F.col("price_elasticity").isNotNull())


# --- cleaning -----------------------------------------------------------------------------------


def resolve_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = clean.resolve_date(fx.flights(spark, sf_dir))
    return dated.select("flight_id", F.date_format("date", "yyyy-MM-dd").alias("date"))


def add_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = clean.add_calendar(clean.resolve_date(fx.flights(spark, sf_dir)))
    return dated.select("flight_id", "month", "day_of_week")


def missing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.missing_counts(fx.flights_with_gaps(spark, sf_dir))


def fill_numeric_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    flights = _kept(spark, fx.flights_with_gaps(spark, sf_dir), "flight_id", "avg_ticket_price", "load_factor")
    filled = clean.fill_numeric_median(flights, ["avg_ticket_price", "load_factor"])
    return rounded_columns(filled, "avg_ticket_price", "load_factor")


def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column with gaps filled, gaps found on the way; all others keep values and types."""
    filled = clean.fill_missing(
        _kept(
            spark,
            fx.flights_with_gaps(spark, sf_dir),
            "flight_id",
            "avg_ticket_price",
            "aircraft_type",
            "booked_seats",
            "route_name",
        )
    )
    return rounded_columns(filled, "avg_ticket_price")


def fill_categorical_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    flights = _kept(spark, fx.flights_with_gaps(spark, sf_dir), "flight_id", "aircraft_type", "route_name")
    return clean.fill_categorical_mode(flights, ["aircraft_type", "route_name"])


def resolve_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = clean.resolve_aliases(fx.flights(spark, sf_dir))
    return named.select("flight_id", "profit_margin", "profit_rate", "ticket_price", "sold_seats")


def iqr_outlier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = clean.iqr_outlier_counts(_analytic(spark, sf_dir, *IQR_COLUMNS))
    return rounded_columns(counts, "lower_bound", "upper_bound")


def cap_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = clean.cap_iqr(_analytic(spark, sf_dir, "flight_id", *IQR_COLUMNS))
    return rounded_columns(capped, *IQR_COLUMNS)


def route_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    unnamed = fx.flights(spark, sf_dir).drop("route_name")
    return clean.ensure_route_name(unnamed).select("flight_id", "route_name")


def split_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = clean.split_route(fx.flights(spark, sf_dir))
    return parts.select("flight_id", "route_name", "origin", "destination")


def preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean.preprocess(fx.flights_with_gaps(spark, sf_dir), folder=fx.work_folder(spark)).select(
        "flight_id",
        "route_name",
        "aircraft_type",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "month",
        "day_of_week",
        "ticket_price",
        "avg_ticket_price",
        "load_factor",
        "profit_margin",
        "sold_seats",
        "price_elasticity",
    )
    return rounded_columns(
        cleaned, "ticket_price", "avg_ticket_price", "load_factor", "profit_margin"
    )


# --- economics ----------------------------------------------------------------------------------


def _economics(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return economics.flight_economics(fx.flight_plan(spark, sf_dir)).select("flight_id", *names)


def demand_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    adjusted = economics.season_adjust(fx.flight_plan(spark, sf_dir))
    return economics.demand_factors(adjusted).select(
        "flight_id", "adjusted_seasonal_index", "day_factor", "holiday_factor"
    )


def flight_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return economics.flight_cost(fx.flight_plan(spark, sf_dir)).select(
        "flight_id",
        "flight_hours",
        "variable_cost",
        "fixed_cost",
        "maintenance_cost",
        "total_cost",
    )


def load_and_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _economics(
        spark,
        sf_dir,
        "load_factor",
        "booked_seats",
        "competitor_load_factor",
        "historical_load_factor",
    )


def discount_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _economics(spark, sf_dir, "load_factor", "discount_low", "discount_high")


def ticket_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _economics(spark, sf_dir, "avg_ticket_price")


def revenue_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operational figures of the plan, and the analytic margin from the same money columns."""
    priced = economics.flight_economics(fx.flight_plan(spark, sf_dir))
    names = (
        "flight_id",
        "passenger_revenue",
        "total_revenue",
        "marginal_contribution",
        "marginal_contribution_rate",
        "operational_profit",
        "profit_rate",
    )
    analytic = priced.withColumnRenamed("profit", "operational_profit").withColumn(
        "revenue", F.col("total_revenue")
    )
    return economics.margin(analytic).select(*names, "profit", "profit_margin")


def unit_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _economics(spark, sf_dir, "ask", "rask")


def optimal_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _economics(spark, sf_dir, "price_lower_bound", "price_upper_bound", "optimal_price")


# --- lookups ------------------------------------------------------------------------------------


def route_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = fx.flights(spark, sf_dir).select("flight_id", "route_name", "total_revenue")
    return lookup.with_route_attrs(plain, fx.route_dimension(spark, sf_dir))


def capacity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = fx.flights(spark, sf_dir).select("flight_id", "aircraft_type", "total_revenue")
    found = lookup.with_capacity(plain, fx.aircraft_dimension(spark, sf_dir))
    return found.withColumn("seats", F.coalesce("seats", F.lit(-1)))


def holiday_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = fx.flights(spark, sf_dir).select("flight_id", "flight_date", "total_revenue")
    return lookup.with_holiday_flag(plain, fx.holiday_dimension(spark))


def subsidy_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = fx.flights(spark, sf_dir).select("flight_id", "route_name")
    return lookup.with_subsidy_tier(plain, fx.tier_dimension(spark, sf_dir))


def select_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = rank.select_routes(_profile(spark, _analytic(spark, sf_dir, *_PROFILED)), max_routes=20)
    return chosen.withColumn("seasonal_index", _map_text(F.col("seasonal_index")))


def route_flight_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lookup.route_flight_numbers(fx.flights(spark, sf_dir))
    return listed.select("route_name", F.array_join("flight_numbers", ",").alias("flight_numbers"))


# --- statistics ---------------------------------------------------------------------------------

_MEANS = ("load_factor", "avg_ticket_price", "profit_rate", "marginal_contribution_rate")
_STATS = (*_MEANS, "total_revenue", "profit")


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.overview(fx.flights(spark, sf_dir))


def overall_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(stats.overall_means(fx.flights(spark, sf_dir)), *_MEANS)


def route_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(stats.route_stats(fx.flights(spark, sf_dir)), *_STATS)


def route_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("load_factor", "avg_ticket_price", "profit_rate")
    return rounded_columns(stats.route_stats(fx.flights(spark, sf_dir), names), *names)


def load_price_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(
        stats.load_price_corr(fx.flights(spark, sf_dir)), "load_price_corr", digits=6
    )


def price_elasticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(
        elasticity.price_elasticity(_analytic(spark, sf_dir, "route_name", "ticket_price", "sold_seats")), "price_elasticity"
    )


def elasticity_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By route and aircraft type, so that small groups occur."""
    finer = _analytic(spark, sf_dir, *_PROFILED, "aircraft_type").withColumn(
        "route_name", F.concat("route_name", F.lit("/"), "aircraft_type")
    )
    return rounded_columns(elasticity.elasticity_or_supplied(finer), "price_elasticity")


def elasticity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = elasticity.elasticity_rank(
        elasticity.supplied_elasticity(fx.flights(spark, sf_dir))
    )
    return rounded_columns(ranked, "price_elasticity")


def route_seasonal_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(
        stats.route_seasonal_index(fx.analytic(spark, sf_dir)), "seasonal_index"
    )


def route_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = profile.route_profile(_analytic(spark, sf_dir, *_PROFILED))
    return profiles.withColumn("seasonal_index", _map_text(F.col("seasonal_index")))


def clean_route_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of the cleaned table, where prices and margins are capped."""
    # The bounds are plain figures, so the passes of the profile cap as they read.
    profiles = profile.route_profile(clean.cap_iqr(_analytic(spark, sf_dir, *_PROFILED)))
    return profiles.withColumn("seasonal_index", _map_text(F.col("seasonal_index")))


def seasonal_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    undated = fx.flights(spark, sf_dir).drop("flight_date")
    return stats.seasonal_fallback(undated).select(
        "route_name",
        rounded_mean(F.col("seasonal_index")["avg"]).alias("avg_index"),
        "sample_count",
    )


def overall_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.overall_stats(fx.analytic(spark, sf_dir))


def monthly_seasonal_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(
        stats.monthly_seasonal_index(fx.analytic(spark, sf_dir)), "seasonal_index"
    )


def load_price_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = stats.load_price_trend(fx.analytic(spark, sf_dir))
    return rounded_columns(line, "slope", "intercept")


def fitted_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = stats.fitted_line(fx.analytic(spark, sf_dir))
    return rounded_columns(points, "load_pct", "fitted_price")


def profit_by_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(stats.profit_by_route(fx.analytic(spark, sf_dir)), "profit_pct")


def revenue_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(
        stats.revenue_cost_by_route(fx.flights(spark, sf_dir)),
        "avg_revenue",
        "avg_cost",
        "avg_profit",
    )


def weekday_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(stats.weekday_load(fx.flights(spark, sf_dir)), "avg_load_factor")


def price_box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = stats.price_box_stats(fx.flights(spark, sf_dir))
    return rounded_columns(boxes, "q1", "median", "q3", "whisker_low", "whisker_high")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.routes(fx.flights(spark, sf_dir))


def report_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(
        stats.report_kpis(fx.analytic(spark, sf_dir)), "avg_load_factor", "avg_profit_margin"
    )


def scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.scatter_points(fx.analytic(spark, sf_dir))


def scatter_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.scatter_points(fx.analytic(spark, sf_dir), max_per_route=20)


def margin_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.margin_scatter(fx.flights(spark, sf_dir))


# --- rankings -----------------------------------------------------------------------------------


def top_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rank.top_bottom(stats.route_stats(fx.flights(spark, sf_dir)))
    return rounded_columns(ranked, "profit_rate", "load_factor", "avg_ticket_price")


def best_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = (
        fx.analytic(spark, sf_dir)
        .groupBy("route_name")
        .agg(rounded_mean(F.avg("profit_margin")).alias("avg_profit_margin"))
    )
    return rank.best_worst(means)


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = rank.preview(fx.analytic(spark, sf_dir), 10, fx.PREVIEW_ORDER)
    return shown.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "route_name",
        "flight_number",
        "flight_id",
        "total_revenue",
        "total_cost",
    )


def middle_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = cut_lineage(
        fx.analytic(spark, sf_dir)
        .groupBy("route_name")
        .agg(rounded_mean(F.avg("profit_margin")).alias("avg_profit_margin")),
        fx.work_folder(spark),
    )
    ranked = rank.best_worst(means)
    best, worst = (ranked.filter(F.col("section") == name) for name in ("best", "worst"))
    return lookup.middle_routes(means, best, worst)


def simplified_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    flights = _analytic(spark, sf_dir, "date", *_PROFILED)
    simple = summary.simplify(flights, _profile(spark, flights), max_routes=5)
    return summary.to_summary_json(simple)


# --- rules and quotes ---------------------------------------------------------------------------


def pricing_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(
        rules.pricing_recommendations(fx.flights(spark, sf_dir)),
        "avg_load_factor",
        "avg_price",
        "avg_profit_rate",
        "avg_marginal_rate",
        "recommended_price",
    )


def flight_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = quotes.quote_flights(fx.requests(spark, sf_dir))
    ranged = quotes.quote_ranges(quotes.expected_margin(quoted))
    return ranged.select(
        "route",
        "date",
        "competitor_price",
        "price_factor",
        "suggested_price",
        "price_low",
        "price_high",
        "expected_margin",
        "expected_margin_high",
        "past_price_low",
        "past_price_high",
        "past_load_low",
        "past_load_high",
        "expected_load_low",
        "expected_load_high",
    )


def quote_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.quote_labels(fx.requests(spark, sf_dir)).select(
        "route",
        "date",
        "elasticity_level",
        "elasticity_word",
        "price_sensitivity",
        "season_level",
        "past_load_level",
        "holiday_reason",
        "weekday_reason",
        "season_reason",
        "load_reason",
        "competition_reason",
        "elasticity_reason",
    )


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    route_figures = cut_lineage(stats.route_stats(fx.flights(spark, sf_dir)), fx.work_folder(spark))
    return report.report_rows(route_figures, rules.recommend(route_figures))


# --- prompts and responses ----------------------------------------------------------------------


def analysis_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flights = _analytic(spark, sf_dir, "date", *_PROFILED)
    simple = summary.simplify(flights, _profile(spark, flights), max_routes=5)
    return prompts.analysis_prompts(
        summary.to_summary_json(simple, pretty=True), prompts.default_queries(spark)
    )


def quote_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Loads are shown with two decimals, as the request form gives them.
    two = {
        c: rounded_mean(F.col(c))
        for c in (
            "load_factor",
            "competitor_load_factor",
            "historical_load_factor",
            "price_elasticity",
        )
    }
    asked = fx.requests(spark, sf_dir).withColumns(two)
    return prompts.quote_prompts(asked).select("route", "date", "prompt")


def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = responses.parse_responses(fx.responses(spark, sf_dir))
    return parsed.select(
        "conv_id",
        "turn",
        "reasoning",
        "answer",
        F.coalesce("reasoning_tokens", F.lit(-1)).alias("reasoning_tokens"),
    )


def parse_responses_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = responses.parse_responses(fx.responses(spark, sf_dir), responses.TAGGED_TEXT)
    return parsed.select("conv_id", "turn", "reasoning", "answer")


def answer_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = responses.parse_responses(fx.responses(spark, sf_dir))
    return responses.answer_preview(parsed).select(
        "conv_id", "turn", "query_preview", "answer_preview"
    )


def results_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question asked twice; for a third of them the second response is empty."""
    asked = fx.responses(spark, sf_dir).withColumn("round", F.explode(F.array(F.lit(1), F.lit(2))))
    empty = (F.col("round") == 2) & ((F.col("conv_id") + F.col("turn")) % 3 == 0)
    again = asked.withColumn("response_json", F.when(empty, F.lit('{"choices":[]}')).otherwise(F.col("response_json")))
    parsed = responses.parse_responses(again)
    keyed = parsed.withColumn("seq", F.struct("conv_id", "turn", "round"))
    return responses.results_table(keyed).select("query", "reasoning", "answer")


# --- whole flows --------------------------------------------------------------------------------


def pricing_summary_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw flights with gaps, cleaned, then profiled."""
    tables = pricing_summary(fx.flights_with_gaps(spark, sf_dir), fx.PREVIEW_ORDER, fx.work_folder(spark))
    return tables["profiles"].withColumn("seasonal_index", _map_text(F.col("seasonal_index")))


def pricing_flow_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of the whole flow: raw flights with gaps, cleaned, profiled, summarised, and a prompt for each question."""
    return pricing_summary(fx.flights_with_gaps(spark, sf_dir), fx.PREVIEW_ORDER, fx.work_folder(spark))["prompts"]


def route_summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of all routes, a row for each."""
    flights = _analytic(spark, sf_dir, "date", *_PROFILED)
    return summary.summary_rows(flights, _profile(spark, flights))


def route_report_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_report(fx.flights(spark, sf_dir), fx.work_folder(spark))["report_rows"]


def load_price_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.load_price_bins(fx.analytic(spark, sf_dir))


def load_margin_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.load_margin_bins(fx.flights(spark, sf_dir))


def route_flight_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.route_flight_pairs(fx.flights(spark, sf_dir))


def flight_number_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flight with the flight numbers of its route."""
    # Flights of a route lie together, so that its text stays in the processor's cache while they take it up.
    flights = _kept(
        spark, fx.flights(spark, sf_dir), "flight_id", "total_revenue", "route_name", "flight_number", order="route_name"
    )
    # A list becomes text once for its route, not again for each of its flights.
    lists = lookup.route_flight_numbers(flights).withColumn("flight_numbers", F.array_join("flight_numbers", ","))
    lists = lookup.sent_whole(cut_lineage(lists, fx.work_folder(spark)))
    looked = lookup.with_flight_numbers(flights.select("flight_id", "total_revenue", "route_name"), lists)
    return looked.select("flight_id", "total_revenue", "flight_numbers")


def simplified_summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shrunk summary with the profiles of all routes kept."""
    flights = _analytic(spark, sf_dir, "date", *_PROFILED)
    simple = summary.simplify(flights, _profile(spark, flights), keep_all=True)
    return summary.to_summary_json(simple)


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of three batches of flights, stored one after the other and one of them twice."""
    path = new_folder(fx.work_folder(spark), "states")
    flights = fx.flights(spark, sf_dir)
    for batch in (0, 1, 2, 1):
        states.keep_states(states.flight_states(flights.filter(F.col("flight_id") % 3 == batch)), path, str(batch))
    return states.kept_states(spark, path)


def kept_route_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(states.route_stats(_batches(spark, sf_dir)), *_STATS)


def kept_route_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(states.route_seasonal_index(_batches(spark, sf_dir)), "seasonal_index")


def kept_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, correlation, trend and report figures over all batches, in one row."""
    kept = cut_lineage(_batches(spark, sf_dir), fx.work_folder(spark))
    parts = (states.overall_means, states.load_price_corr, states.load_price_trend, states.report_kpis)
    names = ("means", "corr", "trend", "kpis")
    row = spark.range(1)
    for name, part in zip(names, parts, strict=True):
        figures = part(kept)
        row = row.withColumn(name, figures.select(F.struct(*figures.columns)).scalar())
    renamed = {"avg_load_factor": "load_pct", "avg_profit_margin": "margin_pct"}
    kpis = [F.col(f"kpis.{c}").alias(renamed.get(c, c)) for c in ("avg_load_factor", "avg_profit_margin", "total_routes", "total_samples")]
    flat = row.select("means.*", "corr.*", "trend.*", *kpis)
    flat = rounded_columns(flat, *states.STAT_MEANS, "slope", "intercept", "load_pct", "margin_pct")
    return rounded_columns(flat, "load_price_corr", digits=6)


def kept_weekday_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rounded_columns(states.weekday_load(_batches(spark, sf_dir)), "avg_load_factor")
    return found.select("day_of_week", "avg_load_factor")


def kept_monthly_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(states.monthly_seasonal_index(_batches(spark, sf_dir)), "seasonal_index")


def kept_route_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean revenue, cost and margin of each route over all batches."""
    kept = cut_lineage(_batches(spark, sf_dir), fx.work_folder(spark))
    money = states.revenue_cost_by_route(kept).join(states.profit_by_route(kept), "route_name")
    return rounded_columns(money, "avg_revenue", "avg_cost", "avg_profit", "profit_pct")


REGISTERED: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    csv_roundtrip,
    summary_json,
    summary_elasticity,
    resolve_date,
    add_calendar,
    missing_counts,
    fill_numeric_median,
    fill_categorical_mode,
    fill_missing,
    resolve_aliases,
    iqr_outlier_counts,
    cap_iqr,
    route_name,
    split_route,
    preprocess,
    demand_factors,
    flight_cost,
    load_and_seats,
    discount_band,
    ticket_price,
    revenue_profit,
    unit_revenue,
    optimal_price,
    route_lookup,
    capacity_lookup,
    holiday_flag,
    subsidy_tier,
    select_routes,
    middle_routes,
    route_flight_numbers,
    overview,
    overall_means,
    route_stats,
    route_means,
    load_price_corr,
    price_elasticity,
    elasticity_fallback,
    elasticity_rank,
    route_seasonal_index,
    route_profile,
    clean_route_profile,
    seasonal_fallback,
    overall_stats,
    monthly_seasonal_index,
    load_price_trend,
    fitted_line,
    profit_by_route,
    revenue_cost,
    weekday_load,
    price_box_stats,
    routes,
    report_kpis,
    scatter_points,
    margin_scatter,
    top_bottom,
    best_worst,
    preview,
    simplified_summary,
    pricing_recommendations,
    flight_quotes,
    quote_labels,
    report_rows,
    analysis_prompts,
    quote_prompts,
    parse_responses,
    parse_responses_alt,
    answer_preview,
    results_table,
    pricing_summary_flow,
    pricing_flow_prompts,
    route_summary_rows,
    route_report_flow,
    load_price_bins,
    load_margin_bins,
    route_flight_pairs,
    flight_number_lookup,
    csv_by_name,
    csv_rejects,
    scatter_sample,
    simplified_summary_all,
    kept_route_stats,
    kept_route_season,
    kept_totals,
    kept_weekday_load,
    kept_monthly_season,
    kept_route_money,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in REGISTERED}
