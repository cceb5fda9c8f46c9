"""Queries whose shuffles or work grew faster than their tables: what they read, and how it is joined. The tables are made here."""

from __future__ import annotations

import datetime
import re

import pytest

from checks import fixtures, queries
from farelens.operators import lookup
from farelens.plans import pricing_summary
from farelens.sources import read_flights, write_csv

_KINDS = {
    "nation": "n_nationkey INT, n_name STRING",
    "supplier": "s_suppkey BIGINT, s_nationkey INT",
    "customer": "c_custkey BIGINT, c_nationkey INT",
    "part": "p_partkey BIGINT, p_type STRING, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE,"
    " l_discount DOUBLE, l_tax DOUBLE, l_shipdate TIMESTAMP",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folder of tables with keys that are null, missing on the other side or there twice."""
    path = str(tmp_path_factory.mktemp("tables"))
    day = datetime.datetime(1996, 1, 1)
    rows = {
        "nation": [(0, "NORTH"), (1, "SOUTH"), (2, None)],
        "supplier": [(1, 0), (2, 1), (3, 1), (3, 1), (4, None), (4, 0), (None, 0), (5, 9)],
        "customer": [(1, 0), (2, 1), (2, 1), (3, 2), (None, 1)],
        "part": [(1, "STEEL", 10.0), (2, "BRASS", 20.0), (2, "TIN", None), (None, "STEEL", 1.0)],
        "orders": [*[(k, 1 + k % 3) for k in range(1, 60)], (7, 2), (None, 1), (60, None), (61, 77)],
        "lineitem": [
            (k, (k % 4 or None), 1 + k % 6, 1 + k % 7, 1.0 + k % 5, 100.0 + 13 * k % 71, k % 3 / 10, 0.02, day + datetime.timedelta(days=k))
            for k in range(1, 64)
        ],
    }
    for name, listed in rows.items():
        spark.createDataFrame(listed, _KINDS[name]).write.parquet(f"{path}/{name}.parquet")
    return path


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_flight_number_texts_are_made_before_the_join(spark, tables):
    found = queries.flight_number_lookup(spark, tables)
    above = _plan(found).split("Join LeftOuter")
    assert len(above) == 2 and "array_join" not in above[0]
    rows = {r["flight_id"]: r["flight_numbers"] for r in found.collect()}
    assert rows and any("," in (text or "") for text in rows.values())


def _looked_up(spark, tables):
    """The rows of ``flight_number_lookup``, worked out one by one."""
    flights = fixtures.flights(spark, tables).select("flight_id", "total_revenue", "route_name", "flight_number").collect()
    numbers: dict[str, set[str]] = {}
    for f in flights:
        if f["route_name"] is not None and f["flight_number"] is not None:
            numbers.setdefault(f["route_name"], set()).add(f["flight_number"])
    texts = {route: ",".join(sorted(found)) for route, found in numbers.items()}
    return sorted(((f["flight_id"], f["total_revenue"], texts.get(f["route_name"])) for f in flights), key=repr)


def test_flight_number_texts_are_sent_whole_if_their_bytes_allow(spark, tables, monkeypatch):
    """Whatever Spark's own threshold says; the rows are the same with a shuffled join."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        for most, hinted in ((lookup.SENT_BYTES, True), (3, False)):
            monkeypatch.setattr(lookup, "SENT_BYTES", most)
            found = queries.flight_number_lookup(spark, tables)
            assert ("rightHint=(strategy=broadcast)" in _plan(found)) is hinted
            assert sorted(map(tuple, found.collect()), key=repr) == _looked_up(spark, tables)
    finally:
        spark.conf.set(key, before)


def test_bytes_of_texts_are_counted(spark, monkeypatch):
    table = spark.createDataFrame([(None, "éé", 1), ("ab", None, 2)], "route_name STRING, flight_numbers STRING, n INT")
    for most, hinted in ((6, True), (5, False)):
        monkeypatch.setattr(lookup, "SENT_BYTES", most)
        assert ("ResolvedHint" in lookup.sent_whole(table)._jdf.queryExecution().analyzed().toString()) is hinted
    assert lookup.sent_whole(table.limit(0)).count() == 0


def test_written_flights_are_in_the_order_asked_for(spark, tables):
    kept = queries._kept(spark, fixtures.flights(spark, tables), "flight_id", "route_name", order="route_name")
    for file in kept.inputFiles():
        routes = [r["route_name"] for r in spark.read.parquet(file).coalesce(1).collect()]
        assert routes == sorted(routes, key=lambda name: (name is not None, name or ""))
    assert kept.count() == fixtures.flights(spark, tables).count()


def test_lineitem_meets_small_sides_that_are_known_to_be_small(spark, tables):
    """Customers go to the orders and not to the lines; suppliers and nations are joined by themselves, the names last."""
    plan = _plan(fixtures.flights(spark, tables))
    joins = [set(pair) for pair in re.findall(r"Join Inner, \(+(?:cast\()?(\w+)#\d+L?(?: as bigint\))? = (\w+)#", plan)]
    assert joins == [
        {"c_nationkey"},
        {"s_nationkey"},
        {"l_partkey", "p_partkey"},
        {"l_suppkey", "s_suppkey"},
        {"l_orderkey", "o_orderkey"},
        {"o_custkey", "c_custkey"},
    ]


def test_joined_rows_are_those_of_the_keys(spark, tables):
    """Keys that are null or unknown drop a row, repeated ones repeat it, whatever the order of the joins."""
    read = {name: [tuple(r) for r in spark.read.parquet(f"{tables}/{name}.parquet").collect()] for name in _KINDS}
    expected = []
    for order, part, supplier, line, *_ in read["lineitem"]:
        for _, customer in (o for o in read["orders"] if o[0] == order is not None):
            for _, to in (c for c in read["customer"] if c[0] == customer is not None):
                for _, origin in (s for s in read["supplier"] if s[0] == supplier is not None):
                    for _, kind, _ in (p for p in read["part"] if p[0] == part is not None):
                        for _, a in (n for n in read["nation"] if n[0] == origin is not None):
                            for _, b in (n for n in read["nation"] if n[0] == to is not None):
                                expected.append((order * 10 + line, kind, None if None in (a, b) else f"{a}-{b}"))
    got = [tuple(r) for r in fixtures.flights(spark, tables).select("flight_id", "aircraft_type", "route_name").collect()]
    assert expected and sorted(got, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize(
    "name",
    ["fill_missing", "fill_numeric_median", "fill_categorical_mode", "cap_iqr", "iqr_outlier_counts", "route_profile", "clean_route_profile"]
    + ["summary_json", "route_summary_rows", "simplified_summary_all", "flight_number_lookup"],
)
def test_passes_read_the_flights_written_once(spark, tables, name):
    found = getattr(queries, name)(spark, tables)
    read = found.inputFiles()
    assert read and not [file for file in read if "/lineitem.parquet/" in file]
    assert found.count() > 0


def test_cleaned_flights_are_not_written_again(spark, tables, tmp_path):
    """Below the folder are the dated flights and the profiles."""
    made = pricing_summary(fixtures.flights_with_gaps(spark, tables), fixtures.PREVIEW_ORDER, str(tmp_path / "work"))
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "work").iterdir()) == ["dated", "table"]
    assert made["cleaned"].count() == fixtures.flights(spark, tables).count() > 0


def test_csv_is_packed_and_read_back(spark, tmp_path):
    path = str(tmp_path / "packed")
    rows = [(1, "a,b"), (2, 'c "d"'), (3, None)]
    write_csv(spark.createDataFrame(rows, "a BIGINT, b STRING"), path, "gzip")
    assert all(p.name.endswith(".csv.gz") for p in (tmp_path / "packed").glob("part-*"))
    assert sorted(map(tuple, read_flights(spark, path, "a BIGINT, b STRING").collect())) == rows
