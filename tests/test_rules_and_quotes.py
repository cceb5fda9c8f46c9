from __future__ import annotations

import pytest

from farelens import fixed_values as fixed
from farelens.operators import quotes, rules
from farelens.schema import REQUEST_SCHEMA
from farelens.streaming import price_requests, read_requests, write_quotes


def test_recommendation_branches_and_boundaries(spark):
    cases = {
        "raise": (0.86, -0.1, fixed.RAISE),
        "small raise": (0.9, 0.1, fixed.SMALL_RAISE),
        "high load, zero profit": (0.9, 0.0, fixed.KEEP),
        "at 0.85, loss": (0.85, -0.1, fixed.OPTIMISE_COST),
        "at 0.85, profit": (0.85, 0.1, fixed.KEEP),
        "at 0.6, loss": (0.6, -0.1, fixed.OPTIMISE_COST),
        "low load, loss": (0.59, -0.1, fixed.LOWER),
        "low load, profit": (0.5, 0.1, fixed.KEEP),
    }
    rows = [(name, load, 100.0, profit, 0.3) for name, (load, profit, _) in cases.items()]
    df = spark.createDataFrame(
        [*rows, (None, 0.5, 1.0, 0.1, 0.1)],
        "route_name STRING, load_factor DOUBLE, avg_ticket_price DOUBLE, profit_rate DOUBLE, "
        "marginal_contribution_rate DOUBLE",
    )
    got = {r["route_name"]: r for r in rules.pricing_recommendations(df).collect()}
    assert set(got) == set(cases)
    for name, (_, _, (strategy, adjustment, reason)) in cases.items():
        r = got[name]
        assert (r["strategy"], r["price_adjustment"], r["reason"]) == (strategy, adjustment, reason)
        assert r["recommended_price"] == pytest.approx(100.0 * (1 + adjustment))


def plain_quote(r):
    """The quote of one request, in plain Python."""
    factor = 1.15 if r["is_holiday"] else 1.0
    day = r["day_of_week"]
    factor *= 1.08 if day in ("周五", "周日") else 1.12 if day == "周六" else 0.95
    factor *= r["seasonal_index"]
    load = 1.1 if r["load_factor"] > 0.85 else 0.9 if r["load_factor"] < 0.7 else 1.0
    rival = r["competitor_load_factor"]
    factor *= load
    factor *= 1.05 if rival > 0.85 else 0.95 if rival < 0.7 else 1.0
    elastic = r["price_elasticity"]
    factor *= 0.95 if elastic > 1.2 else 1.05 if elastic < 0.8 else 1.0
    suggested = round(r["competitor_price"] * factor)
    margin = max(0.05, min(0.3, 0.15 + (load - 0.8) * 0.5))
    return suggested, round(suggested * 0.9), round(suggested * 1.1), margin


def sample_requests():
    loads = (0.69, 0.7, 0.85, 0.86)
    rows = []
    for i in range(96):
        rows.append(
            {
                "route": "r",
                "date": "2025-02-03",
                "is_holiday": i % 2 == 0,
                "day_of_week": fixed.WEEKDAY_NAMES[i % 7],
                "aircraft_type": "738",
                "seat_capacity": 166,
                "price_elasticity": (0.79, 0.8, 1.0, 1.2, 1.21)[i % 5],
                "seasonal_index": (0.85, 0.9, 1.0, 1.1, 1.15)[i % 5],
                "load_factor": loads[i % 4],
                "competitor_load_factor": loads[(i // 4) % 4],
                "historical_load_factor": 0.8,
                "competitor_price": 501 + 37 * i,
            }
        )
    return rows


def test_quotes_against_plain_python(spark):
    rows = sample_requests()
    df = spark.createDataFrame(rows, REQUEST_SCHEMA)
    for given, r in zip(rows, price_requests(df).collect()):
        suggested, low, high, margin = plain_quote(given)
        assert (r["suggested_price"], r["price_low"], r["price_high"]) == (suggested, low, high)
        assert r["price_low"] <= r["suggested_price"] <= r["price_high"]
        assert r["expected_margin"] == pytest.approx(margin)
        assert r["expected_margin_high"] == pytest.approx(margin + 0.05)
        assert r["past_price_low"] == int(f"{given['competitor_price'] * 0.95:.0f}")
        assert r["past_price_high"] == int(f"{given['competitor_price'] * 1.05:.0f}")
        assert r["expected_load_high"] == int(f"{min(98, given['load_factor'] * 100 + 5):.0f}")


def test_quote_labels_at_thresholds(spark):
    df = spark.createDataFrame(sample_requests(), REQUEST_SCHEMA)
    seen = {}
    for r in quotes.quote_labels(df).collect():
        seen[r["price_elasticity"]] = (r["elasticity_level"], r["elasticity_word"], r["price_sensitivity"])
        season = r["seasonal_index"]
        assert r["season_level"] == ("高于" if season > 1 else "低于")
        assert r["season_reason"] == (
            "处于旅游旺季" if season > 1.1 else "处于淡季" if season < 0.9 else "季节性因素适中"
        )
        assert r["past_load_level"] == ("高于" if 0.8 > r["load_factor"] else "低于")
    assert seen[1.21] == ("高", "非常敏感", "高")
    assert seen[1.2] == seen[1.0] == ("中", "较为敏感", "中等")
    assert seen[0.8] == seen[0.79] == ("低", "不太敏感", "低")


def test_a_stream_of_requests_gets_the_same_quotes(spark, tmp_path):
    df = spark.createDataFrame(sample_requests(), REQUEST_SCHEMA)
    df.repartition(3).write.json(str(tmp_path / "requests"))
    stream = price_requests(read_requests(spark, str(tmp_path / "requests"), 1))
    query = (
        write_quotes(stream, str(tmp_path / "quotes"), str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "quotes"))
    batch = price_requests(df)
    assert streamed.count() == batch.count() == 96
    assert batch.select(streamed.columns).exceptAll(streamed).count() == 0
