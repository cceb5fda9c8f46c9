"""Kept states, files read by name, documents in lines, bounded scatters and results that arrive."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from farelens.operators import responses, states, stats, summary
from farelens.plans import route_report
from farelens.sources import read_document_routes, read_flights, scan_flights, write_document
from farelens.streaming import read_results, write_results
from tests.conftest import SF_DIR


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def same_rows(got, expected):
    got, expected = ([tuple(r[c] for c in got.columns) for r in t.collect()] for t in (got, expected))
    order = lambda r: repr([x for x in r if not isinstance(x, float)])
    pairs = list(zip(sorted(got, key=order), sorted(expected, key=order), strict=True))
    assert pairs and all(close(a, b) for x, y in pairs for a, b in zip(x, y, strict=True))


@pytest.fixture(scope="module")
def flights(spark):
    return fx.flights(spark, SF_DIR).cache()


@pytest.fixture(scope="module")
def kept(spark, flights, tmp_path_factory):
    """Four batches, one empty and one stored twice."""
    path = str(tmp_path_factory.mktemp("states"))
    for batch, part in enumerate(("flight_id % 3 = 0", "false", "flight_id % 3 = 1", "flight_id % 3 = 2", "flight_id % 3 = 1")):
        name = "1" if "= 1" in part else f"b{batch}"
        states.keep_states(states.flight_states(flights.filter(part)), path, name)
    return states.kept_states(spark, path).cache()


def test_batches_equal_all_at_once(flights, kept):
    priced = flights.withColumn("ticket_price", F.col("avg_ticket_price")).withColumn("month", F.month("flight_date"))
    margin = flights.withColumn("profit_margin", F.col("profit_rate"))
    same_rows(states.overall_means(kept), stats.overall_means(flights))
    same_rows(states.route_stats(kept), stats.route_stats(flights))
    same_rows(states.route_stats(kept, ["load_factor"]), stats.route_stats(flights, ["load_factor"]))
    same_rows(states.load_price_corr(kept), stats.load_price_corr(flights))
    same_rows(states.load_price_trend(kept), stats.load_price_trend(flights, "avg_ticket_price"))
    same_rows(states.profit_by_route(kept), stats.profit_by_route(margin))
    same_rows(states.revenue_cost_by_route(kept), stats.revenue_cost_by_route(flights))
    same_rows(states.weekday_load(kept), stats.weekday_load(flights))
    same_rows(states.report_kpis(kept), stats.report_kpis(margin))
    same_rows(states.monthly_seasonal_index(kept), stats.monthly_seasonal_index(priced))
    same_rows(states.route_seasonal_index(kept), stats.route_seasonal_index(priced))
    assert states.route_stats(kept).first() is not None


def test_states_without_variation(spark):
    df = spark.createDataFrame(
        [("A-B", "F1", k, "2025-02-03", 1, 0.7, 310.1, None) for k in range(7)],
        "route_name STRING, flight_number STRING, flight_id LONG, flight_date STRING, day_of_week INT, load_factor DOUBLE, "
        "avg_ticket_price DOUBLE, profit_rate DOUBLE",
    )
    kept = states.merge_states(states.flight_states(df), states.flight_states(df.limit(0)))
    assert states.load_price_corr(kept).first()[0] is None and states.load_price_trend(kept).first()[0] is None
    assert states.overall_means(kept).first()["profit_rate"] is None
    assert states.overview(kept, 8).first().asDict()["n_flight_numbers"] == 1


def test_distinct_counts_by_sketch(spark, flights, kept):
    exact = stats.overview(flights).first()
    for rough in (stats.overview(flights, exact=False).first(), states.overview(kept, len(flights.columns)).first()):
        assert rough["n_rows"] == exact["n_rows"] and rough["first_date"] == exact["first_date"]
        assert abs(rough["n_flight_numbers"] - exact["n_flight_numbers"]) <= 0.03 * exact["n_flight_numbers"]
        assert abs(rough["n_routes"] - exact["n_routes"]) <= 0.03 * exact["n_routes"]
    many = spark.range(200_000).select(
        F.concat(F.lit("r"), F.col("id") % 50_000).alias("route_name"), F.col("id").cast("string").alias("flight_number"), F.lit("x").alias("flight_date")
    )
    rough = stats.overview(many, exact=False).first()
    assert abs(rough["n_routes"] - 50_000) < 1500 and abs(rough["n_flight_numbers"] - 200_000) < 6000


def test_report_reads_the_flights_once_and_over_batches(spark, flights, tmp_path):
    folder, kept = str(tmp_path / "work"), str(tmp_path / "kept")
    route_report(flights.filter("flight_id % 2 = 0"), folder, kept=kept, batch="even")
    tables = route_report(flights.filter("flight_id % 2 = 1"), folder, kept=kept, batch="odd")
    same_rows(tables["route_stats"], stats.route_stats(flights))
    whole = route_report(flights, folder)
    same_rows(whole["overview"], stats.overview(flights))
    same_rows(whole["price_box_stats"], stats.price_box_stats(flights))
    for table in whole.values():
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "lineitem" not in plan and "InMemoryRelation" not in plan


def write(path, name, text):
    path.mkdir(exist_ok=True)
    (path / name).write_text(text, encoding="utf-8")


SCHEMA = "id LONG, name STRING, price DOUBLE, day DATE"


def test_files_are_read_by_name(spark, tmp_path):
    write(tmp_path, "a.csv", "﻿id,name,price,day\n1,x,2.5,2025-01-02\n2,NA,,\n3,y,cheap,2025-13-40\n")
    write(tmp_path, "b.csv", 'day,price,"the, note",name,id\n2025-02-03,7,n,z,4\n2025-02-03,8,n,z\n2025-02-03,9,n,"q,q",6,7\n')
    write(tmp_path, "c.csv", "name,id\nonly,9\n")
    write(tmp_path, "d.csv", "")
    write(tmp_path, "e.csv", "id,name,price,day\n")
    scan = scan_flights(spark, str(tmp_path), SCHEMA)
    rows = sorted(tuple(map(str, r)) for r in scan.rows.collect())
    assert rows == [("1", "x", "2.5", "2025-01-02"), ("2", "None", "None", "None"), ("4", "z", "7.0", "2025-02-03"), ("9", "only", "None", "None"), ("None", "z", "8.0", "2025-02-03")]
    rejects = sorted((r["file"][-5:], r["column"] or "", r["value"] or "") for r in scan.rejects.collect())
    assert rejects == [("a.csv", "day", "2025-13-40"), ("a.csv", "price", "cheap"), ("b.csv", "", "")]
    lines = {r["line"] for r in scan.rejects.collect()}
    assert lines == {"3,y,cheap,2025-13-40", '2025-02-03,9,n,"q,q",6,7'}
    with pytest.raises(Exception, match="column price cannot hold"):
        read_flights(spark, str(tmp_path / "a.csv"), SCHEMA).collect()
    with pytest.raises(Exception, match="too many fields"):
        read_flights(spark, str(tmp_path / "b.csv"), SCHEMA).collect()
    assert read_flights(spark, str(tmp_path / "c.csv"), "id LONG, name STRING").first()["id"] == 9
    with pytest.raises(ValueError, match="no file has the columns: price"):
        read_flights(spark, str(tmp_path / "c.csv"), "id LONG, price DOUBLE")
    assert scan_flights(spark, str(tmp_path / "d.csv"), SCHEMA).rows.count() == 0


def test_packed_files_are_read_by_name(spark, tmp_path):
    df = spark.createDataFrame([(5, "x", 1.5)], "id LONG, name STRING, price DOUBLE")
    df.select("price", "name", "id").write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "packed"))
    assert tuple(read_flights(spark, str(tmp_path / "packed"), "id LONG, name STRING, price DOUBLE").first()) == (5, "x", 1.5)


def profiles(spark, n):
    name = F.format_string('R"%06d-Ü', F.col("id"))
    return spark.range(n).select(
        name.alias("route_name"),
        (F.col("id") % 97 / 7.0).alias("avg_price"),
        F.lit(0.5).alias("avg_load_factor"),
        (F.col("id") % 89 / 89.0).alias("avg_profit_margin"),
        F.when(F.col("id") % 5 > 0, F.col("id") / 10.0).alias("price_elasticity"),
        F.create_map(F.lit("1"), F.lit(1.5)).alias("seasonal_index"),
        F.lit(3).cast("long").alias("sample_count"),
    )


def sample(spark):
    return spark.createDataFrame([("A-B", 2.0, 0.5, 0.1, "2025-01-02")], "route_name STRING, ticket_price DOUBLE, load_factor DOUBLE, profit_margin DOUBLE, day STRING").selectExpr("* EXCEPT (day)", "DATE(day) AS date")


def test_document_of_many_routes(spark, tmp_path):
    """200,000 routes: every line holds one, the files together are one JSON text, and routes are read back line by line."""
    profile = profiles(spark, 200_000)
    lines = summary.summary_document(sample(spark), profile, ["date"])
    plan = lines.filter("section = 1")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    write_document(lines, str(tmp_path / "document"))
    parts = sorted((tmp_path / "document").glob("part-*"))
    assert len(parts) > 1
    text = "".join(p.read_text(encoding="utf-8") for p in parts)
    assert max(map(len, text.split("\n"))) < 2000
    whole = json.loads(text)
    assert len(whole["route_stats"]) == 200_000 and list(whole["route_stats"]) == sorted(whole["route_stats"])
    assert list(whole) == ["overall_stats", "best_performing_routes", "worst_performing_routes", "route_stats", "sample_data"]
    back = read_document_routes(spark, str(tmp_path / "document"))
    assert back.count() == 200_000
    some = back.filter(F.col("route_name") == 'R"000007-Ü').first()["profile"]
    assert some["price_elasticity"] == 0.7 and some["seasonal_index"] == {"1": 1.5}


@pytest.mark.parametrize("n", [0, 1, 7])
def test_document_equals_the_nested_row(spark, n):
    profile, rows = profiles(spark, n), sample(spark)
    lines = summary.summary_document(rows, profile, ["date"]).orderBy("section", "route_name").collect()
    nested = summary.to_summary_json(summary.data_summary(rows, profile, ["date"])).first()[0]
    assert json.loads("".join(r["line"] for r in lines)) == json.loads(nested)


def test_scatter_is_cut_before_the_shuffle(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("route_name"), F.col("id").alias("flight_id"), F.lit(0.5).alias("load_factor"),
        F.col("id").cast("double").alias("ticket_price"),
    )
    points = stats.scatter_points(df, max_per_route=150)
    assert {r["route_name"]: r["count"] for r in points.groupBy("route_name").count().collect()} == {"hot": 150, "rare": 100}
    assert points.exceptAll(stats.scatter_points(df.repartition(7), max_per_route=150)).count() == 0
    plan = points._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
    assert stats.scatter_points(df).count() == 5000


def test_results_that_arrive_in_batches(spark, tmp_path):
    """Late, repeated and newer responses in three batches give the table of all at once."""
    rows = [
        [("a", 1, "first a"), ("b", 2, "first b"), ("c", 3, "c")],
        [("a", 5, "newest a"), ("b", 1, "late b"), ("d", 4, None)],
        [("a", 4, "late a"), ("c", 3, "c"), ("d", 6, "d at last"), (None, 7, "no question")],
    ]
    kind = "query STRING, seq LONG, reasoning STRING, answer STRING, response_json STRING"
    full = [[(q, s, f"why {s}", a, f"{{{s}}}") for q, s, a in batch] for batch in rows]
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    for batch in full:
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
        query = write_results(stream, out, state).trigger(availableNow=True).start()
        query.awaitTermination()
    every = spark.createDataFrame([r for batch in full for r in batch], kind)
    expected = {tuple(r) for r in responses.results_table(every).collect()}
    got = read_results(spark, out)
    assert {tuple(r[c] for c in ("query", "reasoning", "answer", "response_json")) for r in got.collect()} == expected
    assert got.count() == 5
