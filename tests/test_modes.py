"""Modes against plain counting, and what is shuffled for columns whose values nearly all differ."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql import types as T

from farelens.operators import clean, modes


def plain_mode(values):
    counts = Counter(v for v in values if v is not None)
    return min(counts, key=lambda v: (-counts[v], v)) if counts else None


def text_frame(spark, columns):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema).repartition(4)


def columns_of(n, rng):
    """Columns of every kind: few values, ties, all different, one frequent among different ones, pairs, only empty, no values."""
    return {
        "few": [rng.choice(["a", "b", "c", None]) for _ in range(n)],
        "tied": ["x" if k % 2 else "w" for k in range(n)],
        "id": [f"id-{k:06d}" for k in rng.sample(range(10 * n), n)],
        "heavy": ["unknown" if k % 5 == 0 else f"n{k}" for k in range(n)],
        "pairs": [f"p{k // 2}" for k in range(n)],
        "thrice": [f"t{k}" if k > 2 else "three" for k in range(n)],
        "empty": ["" if k % 3 else None for k in range(n)],
        "none": [None] * n,
        "odd `name`": [rng.choice(["é", "日本", "z"]) for _ in range(n)],
    }


def test_modes_of_all_kinds_of_columns(spark):
    columns = columns_of(2_000, random.Random(4))
    df = text_frame(spark, columns)
    assert modes.column_modes(df, list(columns)) == [plain_mode(v) for v in columns.values()]
    assert modes.column_modes(df.limit(0), list(columns)) == [None] * len(columns)
    assert modes.column_modes(df, []) == []


def test_modes_when_cells_are_crowded(spark, monkeypatch):
    """Few cells hold many values each, so bounds prove little and the open cells are counted."""
    monkeypatch.setattr(modes, "CELLS", 8)
    monkeypatch.setattr(modes, "TOP_CELLS", 1)
    for seed in range(3):
        columns = columns_of(300, random.Random(seed))
        assert modes.column_modes(text_frame(spark, columns), list(columns)) == [plain_mode(v) for v in columns.values()]


def test_modes_when_hashes_collide(spark, monkeypatch):
    """Hashes that put several values together only cost a further count."""
    monkeypatch.setattr(modes, "_hash", lambda: F.pmod(F.xxhash64("value"), F.lit(5)))
    monkeypatch.setattr(modes, "TOP_CELLS", 1)
    columns = columns_of(200, random.Random(9))
    assert modes.column_modes(text_frame(spark, columns), list(columns)) == [plain_mode(v) for v in columns.values()]


def test_no_value_of_a_nearly_unique_column_is_counted_without_need(spark, monkeypatch):
    """The values that are counted are those of the largest cells; open cells are left where the bounds prove the mode."""
    seen = []
    best = modes._best
    monkeypatch.setattr(modes, "_best", lambda values: seen.append(values.distinct().count()) or best(values))
    monkeypatch.setattr(modes, "_finish", None)
    n = 60_000
    value = F.when(F.col("id") % 10 == 0, F.lit("unknown")).otherwise(F.concat(F.lit("flight-"), F.col("id")))
    assert modes.column_modes(spark.range(n).select(value.alias("v")), ["v"]) == ["unknown"]
    assert seen and sum(seen) <= n // 200


def test_a_unique_column_moves_hashes_only(spark, monkeypatch):
    """Beyond the largest cells no value of a column without repeats is counted or moved."""
    seen = []
    best = modes._best
    monkeypatch.setattr(modes, "_best", lambda values: seen.append(values.count()) or best(values))
    n = 40_000
    df = spark.range(n).select(F.concat(F.lit("flight-"), F.lpad(F.col("id").cast("string"), 40, "0")).alias("v"))
    assert modes.column_modes(df, ["v"]) == ["flight-" + "0" * 40]
    assert sum(seen) <= n // 200


def test_fill_with_modes(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "b", None), (4, "b", None)], "k LONG, t STRING, u STRING")
    rows = {r["k"]: (r["t"], r["u"]) for r in clean.fill_categorical_mode(df).collect()}
    assert rows == {1: ("a", None), 2: ("b", None), 3: ("b", None), 4: ("b", None)}
