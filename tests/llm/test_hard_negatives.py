"""Hard negatives against plain loops."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from farelens.llm import hard_negatives, queries

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, b STRING, q STRING, times STRING, block STRING"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "b", "q", "t", "x") for r in rows], SCHEMA).repartition(3)


def vectors(seed, n, dims=12, labels=3):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(labels + 1)]
    rows = []
    for k in range(n):
        label = rng.randrange(labels)
        near = centre[rng.choice((label, labels))]
        rows.append((k, [float(np.float32(x + rng.gauss(0, 0.15))) for x in near], label))
    return rows


def plain(rows, label_of, low=50, high=95):
    """Rows (anchor, positive, rank, negative, scores) with repeated rows as rows of their own."""
    kept = []
    for i, x, own in rows:
        if own is not None and x is not None and all(y is not None and math.isfinite(y) for y in x):
            kept.append((i, [math.floor(256 * float(y)) for y in x], label_of(i, own)))
    score = lambda a, c: sum(x * y for x, y in zip(a, c))
    last = lambda i: (i is None, i or 0)
    out = []
    for at, (anchor, x, own) in enumerate(kept):
        if anchor is None or anchor % 50:
            continue
        others = sorted(((-score(x, y), last(i), i) for k, (i, y, c) in enumerate(kept) if k != at and c == own), key=lambda r: r[:2])
        rest = sorted(((-score(x, y), last(i), i) for i, y, c in kept if c != own), key=lambda r: r[:2])
        for less, _, positive in others[:5]:
            inside = [(i, -s) for s, _, i in rest if low * -less <= 100 * -s <= high * -less]
            out += [(anchor, positive, k + 1, i, -less, s) for k, (i, s) in enumerate(inside[:3])]
    return Counter(out)


def moved(i, own):
    return (own + 1) % 10 if i is not None and i % 7 == 0 else own


def label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def anchors():
    return F.col("vec_id") % 50 == 0


def got(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def odd_rows(rows):
    return [
        *rows, *rows[:3], *rows[:3], (None, rows[5][1], 1), (None, rows[5][1], 1), (1000, None, 1), (1050, [1.0, None], 1), (1100, [], 1),
        (1150, [float("nan")] * 12, 1), (1200, [float("inf")] * 12, 1), (1250, rows[8][1], None), (1300, [0.0] * 12, 2), (1350, rows[9][1][:7], 0),
        (-50, rows[10][1], 1), (50, rows[11][1], 2), (50, rows[11][1], 2),
    ]


@pytest.mark.parametrize("sizes", [(hard_negatives.BLOCK, hard_negatives.GROUP), (64, 3)])
def test_against_loops(spark, sizes):
    rows = odd_rows(vectors(2, 400))
    found = got(hard_negatives.hard_negatives(frame(spark, rows), anchors(), label(), sizes=sizes))
    assert found == plain(rows, moved)
    assert len(found) > 20 and hard_negatives.hard_negatives(frame(spark, rows).limit(0), anchors()).count() == 0


@pytest.mark.parametrize("size", [3e4, 1e6, 1e18])
def test_large_components(spark, size):
    """Sums that need longs are exact; sums beyond a long do not fail."""
    rows = [(i, [float(np.float32(y * size)) for y in x], c) for i, x, c in vectors(4, 120, 5)]
    found = got(hard_negatives.hard_negatives(frame(spark, rows), anchors(), label(), window=(0, 100)))
    if size < 1e18:
        assert found == plain(rows, moved, 0, 100) and max(abs(r[4]) for r in found) > 1 << 32
    else:
        assert all(abs(r[4]) <= 1 << 63 for r in found)


def test_bounds_shrink_the_candidates():
    import pandas as pd

    rows = vectors(7, 3000, 32, 2)
    table = pd.DataFrame({"b": [r[0] for r in rows], "label": [r[2] for r in rows], "times": 1})
    table["q"] = [np.floor(256 * np.array(r[1])).astype("<i8").tobytes() for r in rows]
    block = hard_negatives.Block(table, table.iloc[:20], 1)
    sizes = []

    def watched(keep):
        def look(lower, upper):
            sizes.append(len(lower))
            assert (lower <= upper).all()
            return keep(lower, upper)

        return look

    for anchor in block.anchors:
        places, scores = block.scan(anchor, np.arange(3000), watched(hard_negatives._top(5)))
        exact = anchor @ block.columns
        assert sorted(scores)[-5:] == sorted(exact)[-5:] and (exact[places] == scores).all()
    assert sum(sizes) < 0.8 * 20 * 4 * 3000


def test_query_matches_loops(spark):
    sf_dir = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in table]
    assert got(queries.op13_hard_negatives(spark, sf_dir)) == plain(rows, moved)
