from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from farelens import fixed_values as fixed
from farelens.operators import (
    clean,
    economics,
    lookup,
    profile,
    prompts,
    rank,
    report,
    responses,
    stats,
    summary,
)
from farelens.plans import pricing_summary, route_report, write_route_report
from farelens.schema import FLIGHT_SCHEMA
from farelens.sources import (
    aircraft,
    flight_numbers,
    holidays,
    read_flights,
    read_summary_elasticity,
    routes_dimension,
    subsidy_tiers,
    write_csv,
    write_summary,
)


def margins(spark, n, equal=False):
    rows = [(f"r{i:02d}", 0.1 if equal else i / 100) for i in range(n)]
    return spark.createDataFrame(rows, "route_name STRING, avg_profit_margin DOUBLE")


def plain_selection(n, max_routes, equal):
    """Best and worst lists of the routes, in plain Python; the middle is checked by size."""
    routes = [(f"r{i:02d}", 0.1 if equal else i / 100) for i in range(n)]
    best = [r for r, _ in sorted(routes, key=lambda x: x[1], reverse=True)[:3]]
    worst = [r for r, _ in sorted(routes, key=lambda x: x[1])[:3]]
    middle = [r for r, _ in routes if r not in best and r not in worst]
    room = max_routes - len(best) - len(worst)
    if len(middle) > room:
        middle = middle[: max(0, room)]
    return best, worst, (best + middle + worst)[:max_routes]


@pytest.mark.parametrize("n, max_routes", [(2, 20), (5, 5), (6, 5), (25, 20), (25, 5), (25, 2)])
@pytest.mark.parametrize("equal", [False, True])
def test_route_selection(spark, n, max_routes, equal):
    stats_ = margins(spark, n, equal)
    best, worst, chosen = plain_selection(n, max_routes, equal)
    ranked = rank.best_worst(stats_).orderBy("section", "position").collect()
    assert [r["route_name"] for r in ranked] == best + worst
    got = [r["route_name"] for r in rank.select_routes(stats_, max_routes).collect()]
    assert len(got) == len(set(chosen)) == len(set(got))
    fixed_part = [r for r in chosen if r in best + worst]
    assert set(fixed_part) <= set(got)


def test_sampling_repeats(spark):
    df = margins(spark, 25)
    first, again = (
        [r["route_name"] for r in rank.sample_routes(df, 7).collect()] for _ in range(2)
    )
    other = [r["route_name"] for r in rank.sample_routes(df.repartition(5), 7).collect()]
    assert first == again == other and len(set(first)) == 7
    assert first != [r["route_name"] for r in rank.sample_routes(df, 7, seed=1).collect()]


def small_flights(spark, n=600, routes=8):
    """Operational flights priced from a plan with random rates on the built-in dimensions."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        route = fixed.ROUTES[rng.randrange(routes)]
        rows.append(
            (
                i,
                rng.choice(dict(fixed.FLIGHT_NUMBERS)[route[0]]),
                route[0],
                f"2025-0{rng.randrange(1, 6)}-0{rng.randrange(1, 8)}",
                rng.choice([kind for kind, _ in fixed.AIRCRAFT_SEATS]),
                *[rng.random() for _ in range(8)],
            )
        )
    names = "a b c d e f g h".split()
    df = spark.createDataFrame(
        rows,
        "flight_id LONG, flight_number STRING, route_name STRING, flight_date STRING, "
        "aircraft_type STRING, " + ", ".join(f"{x} DOUBLE" for x in names),
    )
    plan = (
        df.transform(lookup.with_route_attrs, routes_dimension(spark))
        .transform(lookup.with_capacity, aircraft(spark))
        .transform(lookup.with_holiday_flag, holidays(spark))
        .transform(lookup.with_subsidy_tier, subsidy_tiers(spark))
        .selectExpr(
            "*",
            "weekday(CAST(flight_date AS DATE)) + 1 AS day_of_week",
            "10 + 8 * a AS variable_cost_per_hour",
            "5 + 5 * b AS fixed_cost_per_flight",
            "0.5D + 1.5D * c AS maintenance_per_hour",
            "0.65D + 0.25D * d AS base_load_factor",
            "0.7D + 0.3D * e AS discount_rate",
            "rint((subsidy_low + (subsidy_high - subsidy_low) * f) * 100) / 100 AS subsidy_revenue",
            "(g - 0.5D) / 5 AS competitor_load_shift",
            "(h - 0.5D) / 10 AS historical_load_shift",
        )
    )
    priced = economics.flight_economics(plan).withColumns(
        {
            "departure_city": F.col("departure"),
            "arrival_city": F.col("arrival"),
            "competitor_price": F.col("avg_ticket_price"),
            "price_elasticity": F.col("elasticity"),
        }
    )
    return priced.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in FLIGHT_SCHEMA.fields]
    )


@pytest.fixture(scope="module")
def flights(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data") / "flights")
    small_flights(spark).write.parquet(path)
    return spark.read.parquet(path)


def test_economics_of_one_flight(spark):
    df = spark.createDataFrame(
        [("2025-02-01", 6, 1, 166, 500, 1000, "medium", 1.0, 12.0, 6.0, 1.0, 0.7, 0.9, 3.5, 0.1, -0.05)],
        "flight_date STRING, day_of_week INT, is_holiday INT, seat_capacity INT, distance INT, "
        "base_price INT, profitability STRING, seasonal_index DOUBLE, variable_cost_per_hour DOUBLE, "
        "fixed_cost_per_flight DOUBLE, maintenance_per_hour DOUBLE, base_load_factor DOUBLE, "
        "discount_rate DOUBLE, subsidy_revenue DOUBLE, competitor_load_shift DOUBLE, "
        "historical_load_shift DOUBLE",
    )
    r = economics.flight_economics(df).first()
    assert r["flight_hours"] == 0.62  # 0.625, half to even
    assert r["adjusted_seasonal_index"] == pytest.approx(0.9)
    load = 0.7 * 1.15 * 1.3 * 0.9
    assert r["load_factor"] == pytest.approx(load) and r["booked_seats"] == int(166 * load)
    assert (r["discount_low"], r["discount_high"]) == (0.9, 1.0)
    assert r["variable_cost"] == pytest.approx(round(12.0 * 0.7 * 0.62, 2))
    assert r["total_cost"] == pytest.approx(r["variable_cost"] + 4.2 + round(0.62 * 0.7, 2))
    price = round(round(1000 * 0.9 * 0.95, 2) * 1.1, 2)
    assert r["avg_ticket_price"] == pytest.approx(price)
    revenue = round(price * r["booked_seats"] / 10000, 2)
    assert r["total_revenue"] == pytest.approx(revenue + 3.5)
    assert r["profit_rate"] == pytest.approx(round(r["profit"] / r["total_revenue"], 4))
    assert r["ask"] == pytest.approx(8.3) and r["rask"] == pytest.approx(round(r["total_revenue"] / 8.3, 4))
    assert r["price_upper_bound"] == 1200.0
    assert r["optimal_price"] == pytest.approx(round(min(1200.0, price * 1.1), 2))
    assert r["competitor_load_factor"] == pytest.approx(min(0.95, load + 0.1))


def test_rates_are_zero_without_revenue(spark):
    df = spark.createDataFrame([(0.0, 5.0, 2.0)], "total_revenue DOUBLE, total_cost DOUBLE, variable_cost DOUBLE")
    r = economics.profitability(df).first()
    assert (r["profit_rate"], r["marginal_contribution_rate"]) == (0.0, 0.0)
    analytic = df.withColumn("revenue", F.col("total_revenue"))
    assert economics.margin(analytic).first()["profit_margin"] == 0.0


def test_dimensions(spark):
    assert routes_dimension(spark).count() == 20
    assert flight_numbers(spark).selectExpr("sum(size(flight_numbers))").first()[0] == 52
    assert subsidy_tiers(spark).groupBy("subsidy_tier").count().orderBy("subsidy_tier").collect() == [
        ("A", 7),
        ("B", 5),
    ]
    df = spark.createDataFrame([("unknown", "2025-01-01"), (None, "2025-01-02")], "route_name STRING, flight_date STRING")
    twice = holidays(spark).union(holidays(spark))
    flagged = lookup.with_holiday_flag(df, twice).orderBy("flight_date").collect()
    assert [r["is_holiday"] for r in flagged] == [1, 0]
    tiers = lookup.with_subsidy_tier(df, subsidy_tiers(spark)).collect()
    assert {(r["subsidy_tier"], r["subsidy_low"]) for r in tiers} == {("none", 0.0)}


def test_csv_round_trip_with_byte_order_mark(spark, flights, tmp_path):
    write_csv(flights, str(tmp_path / "csv"))
    back = read_flights(spark, str(tmp_path / "csv"))
    assert back.schema == FLIGHT_SCHEMA
    assert back.exceptAll(flights).count() == 0 and back.count() == flights.count()
    header = ",".join(f.name for f in FLIGHT_SCHEMA.fields)
    rest = ",".join([""] * 28)
    (tmp_path / "bom.csv").write_text(
        f"{header}\n7,CA1,北京,NA,x,2025-02-01,6,1,738{rest[:-1]}\n", encoding="utf-8-sig"
    )
    row = read_flights(spark, str(tmp_path / "bom.csv")).first()
    assert row["flight_id"] == 7 and row["departure_city"] == "北京" and row["aircraft_type"] == "738"
    assert row["arrival_city"] is None and row["load_factor"] is None
    wrong = tmp_path / "wrong.csv"
    wrong.write_text("a,b\n1,2\n")
    with pytest.raises(Exception):
        read_flights(spark, str(wrong)).collect()
    guessed = read_flights(spark, str(wrong), "infer")
    assert dict(guessed.dtypes) == {"a": "int", "b": "int"}


def test_nan_counts_as_missing(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a,b\nNaN,x\n1.5,nan\n")
    got = read_flights(spark, str(tmp_path / "n.csv"), "a DOUBLE, b STRING").collect()
    assert [tuple(r) for r in got] == [(None, "x"), (1.5, None)]


def test_flight_sums_add_up(spark, flights):
    per_route = stats.route_stats(flights).agg(F.sum("flight_count"), F.sum("profit")).first()
    whole = flights.agg(F.count("flight_id"), F.sum("profit")).first()
    assert per_route[0] == whole[0] and per_route[1] == pytest.approx(whole[1])


def test_seasonal_index_averages_to_one(spark, flights):
    dated = clean.resolve_aliases(clean.add_calendar(clean.resolve_date(flights)))
    index = stats.route_seasonal_index(dated)
    weights = dated.groupBy("route_name", "month").count()
    means = index.join(weights, ["route_name", "month"]).groupBy("route_name").agg(
        (F.sum(F.col("seasonal_index") * F.col("count")) / F.sum("count")).alias("m")
    )
    assert all(r["m"] == pytest.approx(1.0) for r in means.collect())
    undated = dated.drop("month", "flight_date")
    assert stats.monthly_seasonal_index(undated).count() == 0
    assert stats.monthly_seasonal_index(dated.drop("month")).count() == 5


def test_figures_without_variation_are_null(spark):
    df = spark.createDataFrame([(0.5, 10.0), (0.5, 12.0)], "load_factor DOUBLE, avg_ticket_price DOUBLE")
    assert stats.load_price_corr(df).first()[0] is None
    assert tuple(stats.load_price_trend(df, "avg_ticket_price").first()) == (None, None)
    no_cost = df.withColumn("route_name", F.lit("r"))
    assert stats.revenue_cost_by_route(no_cost).count() == 0


def test_profiles_without_months(spark):
    df = spark.createDataFrame(
        [("a", 10.0, 0.5, 0.1, 1.2), ("a", 20.0, 0.7, 0.3, 0.8)],
        "route_name STRING, ticket_price DOUBLE, load_factor DOUBLE, profit_margin DOUBLE, seasonal_index DOUBLE",
    )
    supplied = profile.route_profile(df).first()
    assert supplied["seasonal_index"] == {"avg": 1.0} and supplied["avg_price"] == 15.0
    assert supplied["price_elasticity"] is None and supplied["sample_count"] == 2
    assert profile.route_profile(df.drop("seasonal_index")).first()["seasonal_index"] == {"avg": 1.0}


def test_batch_report(spark, flights, tmp_path):
    tables = route_report(flights, str(tmp_path / "work"))
    counts = {name: df.count() for name, df in tables.items()}
    assert counts["route_stats"] == counts["recommendations"] == counts["report_rows"] == 8
    assert counts["top_bottom"] == 10
    for name in ("load_price_bins", "load_margin_bins"):
        assert tables[name].agg(F.sum("flights")).first()[0] == 600
    with pytest.raises(ValueError, match="folder"):
        route_report(flights, "")
    write_route_report(tables, str(tmp_path))
    back = spark.read.option("header", True).csv(str(tmp_path / "recommendations"))
    assert back.count() == 8 and "strategy" in back.columns


def test_summary_flow(spark, flights, tmp_path):
    tables = pricing_summary(flights, ("date", "route_name", "flight_id"), str(tmp_path / "work"))
    text = summary.to_summary_json(tables["summary"]).first()["summary_json"]
    data = json.loads(text)
    assert list(data) == [
        "overall_stats",
        "best_performing_routes",
        "worst_performing_routes",
        "route_stats",
        "sample_data",
    ]
    assert data["overall_stats"]["total_samples"] == 600
    assert len(data["route_stats"]) == 8 and list(data["route_stats"]) == sorted(data["route_stats"])
    assert len(data["sample_data"]) == 10 and data["sample_data"][0]["date"].startswith("2025-0")
    months = list(next(iter(data["route_stats"].values()))["seasonal_index"])
    assert months == sorted(months, key=int)
    write_summary(tables["summary"], str(tmp_path / "summary"))
    stored = {
        r["route_name"]: r["price_elasticity"]
        for r in read_summary_elasticity(spark, str(tmp_path / "summary")).collect()
    }
    assert stored == {
        r: v["price_elasticity"]
        for r, v in data["route_stats"].items()
        if v["price_elasticity"] is not None
    }
    asked = tables["prompts"].orderBy("seq").collect()
    assert [r["query"] for r in asked] == list(fixed.DEFAULT_QUERIES)
    for r in asked:
        before, _, after = r["prompt"].partition("```json\n")
        shown = json.loads(after.split("\n        ```")[0])
        assert len(shown["route_stats"]) <= 5 and "sample_data" not in shown
        assert before.startswith("\n        作为一位") and f"\n        {r['query']}\n" in after
    assert summary.route_summary_rows(tables["profiles"]).count() == 8


def test_summary_rows_of_many_routes(spark):
    """More routes than any limit: one overall row, and one row for each route."""
    df = spark.range(120_000).select(
        F.concat(F.lit("r"), "id").alias("route_name"), F.lit(10.0).alias("ticket_price"), F.lit(0.5).alias("load_factor"),
        F.lit(0.1).alias("profit_margin"), F.lit(1).alias("month"), F.lit("2025-02-01").cast("date").alias("date"),
    )
    got = summary.summary_rows(df, profile.route_profile(df)).groupBy("section").count().collect()
    assert {r["section"]: r["count"] for r in got} == {"overall": 1, "route": 120_000}


def test_every_stored_summary_is_read(spark, tmp_path):
    body = '{"route_stats":{"%s":{"price_elasticity":%s}}}'
    (tmp_path / "two.json").write_text(body % ("a", 1.0) + "\n" + body % ("b", 2.0) + "\n")
    got = {r["route_name"]: r["price_elasticity"] for r in read_summary_elasticity(spark, str(tmp_path / "two.json")).collect()}
    assert got == {"a": 1.0, "b": 2.0}
    (tmp_path / "one.json").write_text(json.dumps(json.loads(body % ("c", 3.0)), indent=2))
    assert read_summary_elasticity(spark, str(tmp_path / "one.json"), multi_line=True).first()["route_name"] == "c"


def test_broken_numbers_fail(spark, tmp_path):
    (tmp_path / "b.csv").write_text("a,b\n1.5,x\n\"12,5x\",y\n")
    with pytest.raises(Exception, match="column a cannot hold: 12,5x"):
        read_flights(spark, str(tmp_path / "b.csv"), "a DOUBLE, b STRING").collect()
    assert dict(read_flights(spark, str(tmp_path / "b.csv"), "infer").dtypes)["a"] == "string"


def test_flight_number_lookup(spark):
    df = spark.createDataFrame([("a", "F2"), ("a", "F1"), ("b", None)], "route_name STRING, flight_number STRING")
    got = lookup.with_flight_numbers(df, lookup.route_flight_numbers(df)).collect()
    assert sorted((r["route_name"], tuple(r["flight_numbers"] or ())) for r in got) == [("a", ("F1", "F2"))] * 2 + [("b", ())]


def parse(spark, mode, *bodies):
    df = spark.createDataFrame([(i, json.dumps(b, ensure_ascii=False)) for i, b in enumerate(bodies)], "i INT, response_json STRING")
    rows = responses.parse_responses(df, mode).orderBy("i").collect()
    return [(r["reasoning"], r["answer"]) for r in rows]


def message(content, **more):
    return {"choices": [{"message": {"content": content, **more}}]}


def test_response_shapes(spark):
    shapes = (
        {"error": "timeout"},
        {"error": None},
        {"choices": []},
        {"usage": {}},
        message(" \n答　"),
        message("a<think> x \n</think> b <think>y</think>"),
        message("</think> early <think> late"),
        message("<think> open only"),
        message("答", reasoning_content="想 "),
        message("<think>x</think>答", reasoning_content=None),
        message("一 思考过程 二 # 三 # 四"),
        message("思考过程# 三"),
        message("思考过程 no heading"),
        {"choices": [{"message": {"role": "assistant"}}]},
    )
    short, long = "无法从响应中提取内容", "无法从响应中提取内容: 缺少'choices'字段或为空"
    shared = [
        (None, "错误: timeout"),
        (None, "错误: None"),
        None,
        None,
        (None, "答"),
        ("x", "a b <think>y</think>"),
        ("", "</think> early  early <think> late"),
        (None, "<think> open only"),
    ]
    by_field = [
        *shared,
        ("想 ", "答"),
        (None, "<think>x</think>答"),
        (None, "一 思考过程 二 # 三 # 四"),
        (None, "思考过程# 三"),
        (None, "思考过程 no heading"),
        (None, None),
    ]
    by_field[2] = by_field[3] = (None, short)
    tagged = [
        *shared,
        (None, "答"),
        ("x", "答"),
        ("二", "一 思考过程 二 # 三 # 四"),
        (None, "思考过程# 三"),
        (None, "思考过程 no heading"),
        (None, "无法从响应中提取内容: 缺少'content'字段"),
    ]
    tagged[2] = tagged[3] = (None, long)
    assert parse(spark, responses.REASONING_FIELD, *shapes) == by_field
    assert parse(spark, responses.TAGGED_TEXT, *shapes) == tagged
    with pytest.raises(ValueError):
        responses.parse_responses(spark.createDataFrame([("{}",)], "response_json STRING"), "other")


def test_tokens_previews_and_repeated_questions(spark):
    body = {**message("x" * 101), "usage": {"completion_tokens_details": {"reasoning_tokens": 42}}}
    rows = [("q" * 60, 1, json.dumps(message("old"))), ("q" * 60, 2, json.dumps(body)), ("z", 3, "{}")]
    df = spark.createDataFrame(rows, "query STRING, seq INT, response_json STRING")
    parsed = responses.parse_responses(df)
    assert [r["reasoning_tokens"] for r in parsed.orderBy("seq").collect()] == [None, 42, None]
    shown = responses.answer_preview(parsed).orderBy("seq").collect()
    assert shown[1]["answer_preview"] == "x" * 100 + "..." and shown[0]["answer_preview"] == "old"
    assert shown[0]["query_preview"] == "q" * 50 + "..."
    kept = {r["query"]: r["answer"] for r in responses.results_table(parsed).collect()}
    assert kept["q" * 60] == "x" * 101 and len(kept) == 2


def test_quote_prompt_text(spark):
    df = spark.createDataFrame(
        [("r", "2025-02-03", True, "周一", "738", 166, 1.0, 0.95, 0.8, 0.7, 0.75, 1500)],
        "route STRING, date STRING, is_holiday BOOLEAN, day_of_week STRING, aircraft_type STRING, "
        "seat_capacity INT, price_elasticity DOUBLE, seasonal_index DOUBLE, load_factor DOUBLE, "
        "competitor_load_factor DOUBLE, historical_load_factor DOUBLE, competitor_price INT",
    )
    lines = prompts.quote_prompts(df).first()["prompt"].split("\n")
    assert lines[0] == "" and lines[-1] == " " * 8
    assert lines[5].strip() == "是否假期: 是" and lines[9].strip() == "价格弹性: 1.0"
    assert lines[14].strip() == "竞争对手价格: 1500元"


def test_report_formats(spark):
    df = spark.createDataFrame(
        [("r", 0.12345, 99.995, -0.0001, 0.5, 3)],
        "route_name STRING, load_factor DOUBLE, avg_ticket_price DOUBLE, profit_rate DOUBLE, "
        "marginal_contribution_rate DOUBLE, flight_count LONG",
    )
    r = report.route_rows(df).first()
    assert (r["load_factor"], r["profit_class"], r["marginal_class"]) == ("12.34%", "negative", "positive")
    assert r["profit_rate"] == "-0.01%" and r["flight_count"] == "3"
