from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from farelens.operators import clean


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_flight_date_wins_over_date(spark):
    df = spark.createDataFrame([("2025-02-03", "1999-01-01")], "flight_date STRING, date STRING")
    assert str(clean.resolve_date(df).first()["date"]) == "2025-02-03"
    only_date = clean.resolve_date(df.drop("flight_date"))
    assert str(only_date.first()["date"]) == "1999-01-01"
    neither = df.drop("flight_date", "date").withColumn("x", F.lit(1))
    assert clean.add_calendar(clean.resolve_date(neither)).columns == ["x"]


def test_bad_dates_raise_unless_lenient(spark):
    df = spark.createDataFrame([("no date",)], "flight_date STRING")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        clean.resolve_date(df).collect()
    assert clean.resolve_date(df, lenient=True).first()["date"] is None


def test_calendar_overwrites_weekday(spark):
    df = spark.createDataFrame([("2025-02-03", 1), ("2025-02-09", 7)], "flight_date STRING, day_of_week INT")
    got = rows_of(clean.add_calendar(clean.resolve_date(df)))
    assert [(r["month"], r["day_of_week"]) for r in got] == [(2, 0), (2, 6)]


def test_missing_counts_lists_only_columns_with_gaps(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, None, "y")], "a INT, b STRING, c STRING")
    got = {r["column_name"]: r["missing"] for r in clean.missing_counts(df).collect()}
    assert got == {"a": 1, "b": 2}


def test_fill_missing(spark):
    df = spark.createDataFrame(
        [
            (1, 1.0, "b", "only", True, None),
            (2, None, "a", None, None, None),
            (None, 4.0, None, None, False, None),
            (4, None, "b", None, True, None),
            (5, 2.0, "a", None, True, None),
        ],
        "i INT, d DOUBLE, tie STRING, one STRING, flag BOOLEAN, empty STRING",
    )
    for filled in (
        clean.fill_missing(df),
        clean.fill_missing(df, clean.columns_with_gaps(df)),
        clean.fill_categorical_mode(clean.fill_numeric_median(df)),
    ):
        got = rows_of(filled.orderBy(F.col("i")))
        # Median of 1, 2, 4, 5 is 3; of 1, 4, 2 is 2.
        assert sorted(r["i"] for r in got) == [1.0, 2.0, 3.0, 4.0, 5.0]
        assert sorted(r["d"] for r in got) == [1.0, 2.0, 2.0, 2.0, 4.0]
        # On a tie the smaller text wins.
        assert sorted(r["tie"] for r in got) == ["a", "a", "a", "b", "b"]
        assert {r["one"] for r in got} == {"only"}
        # Booleans are left alone, and a column without any value stays empty.
        assert sum(r["flag"] is None for r in got) == 1
        assert {r["empty"] for r in got} == {None}


def test_calendar_columns_stay_whole(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "month INT")
    filled = clean.fill_numeric_median(df)
    assert dict(filled.dtypes)["month"] == "int"
    assert sorted(r["month"] for r in filled.collect()) == [1, 1, 2]


def test_aliases_do_not_overwrite(spark):
    df = spark.createDataFrame(
        [(0.1, 0.2, 5.0, 7, "r")],
        "profit_rate DOUBLE, profit_margin DOUBLE, avg_ticket_price DOUBLE, booked_seats INT, route STRING",
    )
    got = clean.resolve_aliases(df).first().asDict()
    assert got["profit_margin"] == 0.2 and got["profit_rate"] == 0.1
    assert (got["ticket_price"], got["sold_seats"], got["route_name"]) == (5.0, 7, "r")


def test_cap_and_outlier_counts(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0, -90.0, None]
    df = spark.createDataFrame([(v, 0.5) for v in values], "ticket_price DOUBLE, load_factor DOUBLE")
    q1, q3 = np.quantile([v for v in values if v is not None], [0.25, 0.75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    counts = {r["column_name"]: r for r in clean.iqr_outlier_counts(df).collect()}
    assert set(counts) == {"ticket_price", "load_factor"}
    assert counts["ticket_price"]["outliers"] == 2
    assert counts["ticket_price"]["lower_bound"] == pytest.approx(low)
    assert counts["load_factor"]["outliers"] == 0
    capped = [r["ticket_price"] for r in clean.cap_iqr(df).collect()]
    assert capped[:4] == [1.0, 2.0, 3.0, 4.0]
    assert capped[4:6] == pytest.approx([high, low]) and capped[6] is None


def test_route_name_is_built_only_when_absent(spark):
    df = spark.createDataFrame([("A", "B"), ("A", None)], "departure_city STRING, arrival_city STRING")
    built = clean.ensure_route_name(df)
    assert [r["route_name"] for r in built.collect()] == ["A-B", None]
    assert clean.ensure_route_name(built).columns == built.columns
    parts = clean.split_route(built.filter("route_name IS NOT NULL")).first()
    assert (parts["origin"], parts["destination"]) == ("A", "B")


def test_preprocess_names_missing_columns(spark):
    df = spark.createDataFrame([(1.0, "A", "B")], "load_factor DOUBLE, departure_city STRING, arrival_city STRING")
    with pytest.raises(ValueError, match="ticket_price, profit_margin"):
        clean.preprocess(df)


def test_preprocess_of_a_table_without_dates(spark):
    df = spark.createDataFrame(
        [("r", 10.0, 0.5, 0.1), ("r", None, 0.7, 0.2), (None, 30.0, None, 0.3)],
        "route_name STRING, avg_ticket_price DOUBLE, load_factor DOUBLE, profit_rate DOUBLE",
    )
    got = clean.preprocess(df).select("route_name", "ticket_price", "load_factor", "profit_margin")
    assert sorted(tuple(r) for r in got.collect()) == [
        ("r", 10.0, 0.5, 0.1),
        ("r", 20.0, 0.7, 0.2),
        ("r", 30.0, 0.6, 0.3),
    ]


def test_only_columns_with_gaps_change(spark):
    big = 9007199254740993
    df = spark.createDataFrame(
        [(big, 1, None), (big + 2, None, 3.0), (big + 4, 4, 5.0)], "flight_id LONG, seats INT, price DOUBLE"
    )
    filled = clean.fill_missing(df)
    assert dict(filled.dtypes) == {"flight_id": "bigint", "seats": "double", "price": "double"}
    assert sorted(map(tuple, filled.collect())) == [(big, 1.0, 4.0), (big + 2, 2.5, 3.0), (big + 4, 4.0, 5.0)]
    gaps = df.union(spark.createDataFrame([(None, 1, 1.0)], df.schema))
    ids = {r["flight_id"] for r in clean.fill_missing(gaps).collect()}
    assert {int(i) for i in ids} >= {big, big + 2, big + 4}


def test_nan_is_a_gap(spark):
    rows = [("r", float(p), 0.5, 0.1) for p in range(1, 11)] + [("r", float("nan"), 0.5, 0.1)]
    df = spark.createDataFrame(rows, "route_name STRING, ticket_price DOUBLE, load_factor DOUBLE, profit_margin DOUBLE")
    assert [tuple(r) for r in clean.missing_counts(df).collect()] == [("ticket_price", 1)]
    prices = sorted(r["ticket_price"] for r in clean.preprocess(df).collect())
    assert prices == sorted([*map(float, range(1, 11)), 5.5])


def test_cities_name_the_route_before_another_column_does(spark):
    df = spark.createDataFrame(
        [("x", "A", "B", 1.0, 0.5, 0.1)],
        "route STRING, departure_city STRING, arrival_city STRING, ticket_price DOUBLE, load_factor DOUBLE, profit_margin DOUBLE",
    )
    assert clean.preprocess(df).first()["route_name"] == "A-B"
    assert clean.preprocess(df.drop("arrival_city")).first()["route_name"] == "x"


@pytest.mark.parametrize("nulls", [0, 1, 2, 5, 30])
@pytest.mark.parametrize("n", [1, 2, 3, 8, 21])
def test_bounds_after_filling_come_from_one_search(spark, n, nulls):
    values = [float((7 * k * k) % 23) for k in range(n)]
    df = spark.createDataFrame(
        [("r", v, 0.5, 0.1) for v in [*values, *[None] * nulls]],
        "route_name STRING, ticket_price DOUBLE, load_factor DOUBLE, profit_margin DOUBLE",
    )
    filled = np.array([*values, *[np.median(values)] * nulls])
    q1, q3 = np.quantile(filled, [0.25, 0.75])
    wanted = np.clip(filled, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    got = sorted(r["ticket_price"] for r in clean.preprocess(df).collect())
    assert got == pytest.approx(sorted(wanted.tolist()))
