"""Time the headline queries: one warm-up, then the median of several runs, into a no-op sink.

Environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS, and BENCH_QUERIES (comma separated, or ``all``).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from checks.queries import queries  # noqa: E402

HEADLINE = (
    "route_stats",
    "pricing_recommendations",
    "overview",
    "overall_means",
    "load_price_corr",
    "load_price_trend",
    "route_seasonal_index",
    "monthly_seasonal_index",
    "price_elasticity",
    "price_box_stats",
    "route_profile",
    "iqr_outlier_counts",
    "cap_iqr",
    "fill_numeric_median",
    "fill_categorical_mode",
    "preprocess",
    "top_bottom",
    "optimal_price",
    "route_lookup",
    "flight_quotes",
    "select_routes",
    "summary_json",
    "parse_responses",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    registered = queries()
    names = list(registered) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    times: dict[str, float] = {}
    for name in names:
        spent = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
        times[name] = round(statistics.median(spent[1:]), 3)
        print(f"{name}: {times[name]} s", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
