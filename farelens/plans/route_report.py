"""Route report over raw flights: statistics, rankings, recommendations and chart tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.operators import rank, report, rules, states, stats
from farelens.sources import cut_lineage, write_csv


#: Columns of the flights that the report reads.
COLUMNS = ("route_name", "flight_number", "flight_id", "flight_date", "day_of_week", *states.MEASURES)


def route_report(flights: DataFrame, folder: str, k: int = 5, kept: str | None = None, batch: str = "first") -> dict[str, DataFrame]:
    """All tables of the report. The flights are read once: the columns the report needs are written below ``folder``.

    Works on raw rows, as recommendations need margins that are not capped. ``folder``, shared by all executors, also takes the states
    (``operators.states``) that means, rankings, correlation and advice come from, and the route statistics. With ``kept``, a folder of
    states, the flights are a further ``batch`` of those reported on before: their states join the kept ones, and these figures
    are over all batches. Counts in bins, box plots and the overview are over the given flights.
    """
    needed = cut_lineage(flights.select(*[c for c in COLUMNS if c in flights.columns]), folder)
    partial = states.flight_states(needed)
    if kept is not None:
        states.keep_states(partial, kept, batch)
        partial = states.kept_states(flights.sparkSession, kept)
    partial = cut_lineage(partial, folder)
    route_stats = cut_lineage(states.route_stats(partial), folder)
    recommendations = rules.recommend(route_stats)
    return {
        "overview": stats.overview(needed).withColumn("n_columns", F.lit(len(flights.columns)).cast("long")),
        "overall_means": states.overall_means(partial),
        "route_stats": route_stats,
        "top_bottom": rank.top_bottom(route_stats, k),
        "load_price_corr": states.load_price_corr(partial),
        "recommendations": recommendations,
        "report_rows": report.report_rows(route_stats, recommendations),
        "profit_by_route": states.profit_by_route(partial, ascending=True),
        "load_price_bins": stats.load_price_bins(needed, "avg_ticket_price"),
        "load_margin_bins": stats.load_margin_bins(needed),
        "price_box_stats": stats.price_box_stats(needed),
        "weekday_load": states.weekday_load(partial),
    }


def write_route_report(tables: dict[str, DataFrame], folder: str) -> None:
    """Store route statistics and recommendations as CSV below ``folder``."""
    for name in ("route_stats", "recommendations"):
        write_csv(tables[name], f"{folder.rstrip('/')}/{name}")
