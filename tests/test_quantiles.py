"""Exact quantiles and elasticity against brute force."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from farelens.operators import elasticity, quantiles

PROBS = [0.25, 0.5, 0.75]
SHAPES = {
    "spread": lambda r: r.random() * 1000,
    "cents": lambda r: round(r.random() * 5, 2),
    "one heavy value": lambda r: 7.0 if r.random() < 0.6 else r.random() * 10,
    "long tail": lambda r: r.random() ** -3,
    "constant": lambda r: 3.5,
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("size", [1, 2, 9, 200, 5000])
def test_global_quantiles(spark, shape, size):
    rng = random.Random(size)
    values = [SHAPES[shape](rng) for _ in range(size)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v DOUBLE").repartition(5)
    got = quantiles.exact_quantiles(df, ["v"], PROBS).first()["v"]
    assert got == pytest.approx(np.quantile(values, PROBS).tolist(), rel=1e-12)


def test_quantiles_of_a_hot_group(spark):
    rng = random.Random(3)
    groups = {"hot": 4000, "small": 7, "single": 1, "middle": 600}
    values = {g: [rng.random() * 100 for _ in range(n)] for g, n in groups.items()}
    rows = [(g, v, v * 2) for g, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE, w DOUBLE").repartition(4)
    got = quantiles.exact_quantiles(df, ["v", "w"], PROBS, ["g"]).collect()
    assert {r["g"] for r in got} == set(groups)
    for r in got:
        wanted = np.quantile(values[r["g"]], PROBS)
        assert r["v"] == pytest.approx(wanted.tolist())
        assert r["w"] == pytest.approx((wanted * 2).tolist())


def test_column_without_values_gives_null(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a DOUBLE, b DOUBLE")
    row = quantiles.exact_quantiles(df, ["a", "b"], [0.5]).first()
    assert row["a"] == [1.5] and row["b"] is None


def test_approximate_switch(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert quantiles.exact_quantiles(df, ["v"], [0.5], exact=False).first()["v"] == [500.0]


def test_cells_keep_the_order_of_values(spark):
    rng = random.Random(9)
    values = [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randrange(-300, 300) for _ in range(2000)]
    values += [0.0, -0.0, 1.0, 2.0, 0.5, 1.0 + 2**-52, 1.0 - 2**-53, 5e-324, -5e-324, 1.7e308, float("inf"), float("-inf")]
    values += [2.0**k for k in range(-1074, 1024, 37)] + [np.nextafter(2.0**k, 0) for k in range(-1000, 1024, 37)]
    df = spark.createDataFrame([(float(v),) for v in values], "value DOUBLE")
    rows = df.select("value", quantiles.coarse_cell().alias("a")).collect()
    cells = sorted((r["a"], r["value"]) for r in rows)
    assert [r[1] for r in cells] == sorted(r["value"] for r in rows)


@pytest.mark.parametrize("shape", ["spread", "constant"])
def test_few_rows_reach_the_last_step_of_a_hot_group(spark, shape):
    """Of a large group, distinct or equal, one coarse cell is opened: rows that share the first bits of the middle."""
    value = (F.xxhash64("id") % 1_000_003).cast("double") + 2_000_000.0 if shape == "spread" else F.lit(3.5)
    rows = spark.range(100_000).select(value.alias("value")).withColumn("a", quantiles.coarse_cell())
    picks = quantiles.first_cells(rows, [], lambda size, nulls: F.array((size / 2).cast("long")))
    opened = rows.join(picks.select("a"), "a").groupBy("a", "value").count()
    assert picks.count() == 1
    assert opened.count() < 3000


@pytest.mark.parametrize("reach", [0.4, -0.01])
@pytest.mark.parametrize("kept", [0, 40, 50_000])
def test_brackets_that_miss_or_hold_too_much(spark, monkeypatch, reach, kept):
    """Every rank is proven whatever the brackets: misplaced ones (a negative reach turns them round), wide ones, and ones narrowed again."""
    monkeypatch.setattr(quantiles, "KEPT", kept)
    monkeypatch.setattr(quantiles, "TABLE_REACH", reach)
    monkeypatch.setattr(quantiles, "TABLE_POINTS", 20)
    monkeypatch.setattr(quantiles, "TABLE_SKETCH", 16)
    rng = random.Random(4)
    values = [rng.choice([rng.random() * 100, 5.0, 50.0, -1.0, float("inf")]) for _ in range(3000)] + [float("nan")] * 5
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 3, "v DOUBLE").repartition(4)
    ranks = [1, 2, 700, 1500, 1501, 2999, 3000, 3001]
    found, nulls = quantiles.table_ranks(df, {"v": lambda size, nulls: ranks}, ["v"])
    ordered = sorted(values[:3000]) + values[3000:]
    assert (found["v"].size, found["v"].nulls, nulls) == (3005, 3, {"v": 3})
    assert [repr(found["v"].values[r]) for r in ranks] == [repr(ordered[r - 1]) for r in ranks]


def test_ranks_of_groups(spark):
    rng = random.Random(5)
    groups = {g: [rng.choice([rng.random() * 100, 5.0, -0.5, float("inf")]) for _ in range(n)] for g, n in (("a", 3000), ("b", 40), ("c", 1))}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("none", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g STRING, value DOUBLE").repartition(4)
    wanted = lambda size, nulls: F.array(F.lit(1).cast("long"), F.ceil(size / 2).cast("long"), size)
    ranked = quantiles.ranked_values(df, ["g"], wanted)
    got = {(r["g"], r["rank"]): (r["value"], r["size"], r["nulls"]) for r in ranked.collect()}
    ordered = {g: sorted(vs) for g, vs in groups.items()}
    ordered["a"].append(float("nan"))
    expected = {(g, r): (vs[r - 1], len(vs), int(g == "a")) for g, vs in ordered.items() for r in (1, -(-len(vs) // 2), len(vs))}
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in expected.items()}
