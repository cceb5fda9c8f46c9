"""Prefix shingles of few classes are done before the rounds; later rounds read what is left of the others."""

from __future__ import annotations

import itertools
import random

import pandas as pd
import pytest

from farelens.llm import components, ngram_join
from tests.llm import brute


def test_rounds_do_not_read_shingles_of_few_classes(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for k in range(60):
        # Two texts that share some rare words in a row and are unlike: their shingles never come to lie in one component.
        shared = [f"rare{k}x{j}" for j in range(12)]
        rows += [(2 * k + i, " ".join(shared + [f"own{k}x{i}x{j}" for j in range(20)])) for i in (0, 1)]
    base = [f"base{j}" for j in range(60)]
    for k in range(12):
        words = list(base)
        words[rng.randrange(60)] = f"changed{k}"
        rows.append((1000 + k, " ".join(words)))
    read, plain = [], ngram_join.frozen

    def counted(df, name, *args, **more):
        out = plain(df, name, *args, **more)
        if name == "labelled":
            read.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "frozen", counted)
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs, 4, 80).collect()}
    assert found == {k: c for k, _, c in brute.jaccard_components(rows, 4, 80)}
    # The twelve copies post eleven or twelve shingles each at most; the others post eight that they share with one other.
    assert sum(read) <= 12 * 12


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_shared_shingles_across_batches(spark, batch):
    rng = random.Random(batch)
    rows = []
    for g in range(40):
        for node in rng.sample(range(-50, 50), rng.choice([1, 2, 3, 4, 5, 6, 9])):
            rows += [(g, node, 40 + node % 20, (g * node) % 7)] * rng.choice([1, 1, 2])
    of = {}
    for g, node, n, pos in set(rows):
        of.setdefault(g, []).append((node, n, pos))
    postings, pairs, settled = [], [], 0
    for g, members in of.items():
        if len(members) > ngram_join.FEW:
            postings += [(g, *m) for m in members]
            continue
        settled += len(members) if len(members) > 1 else 0
        for (u, n, p), (v, m, q) in itertools.combinations(sorted(members), 2):
            needed = -(-(n + m) * 80 // 180)
            if 100 * min(n, m) >= 80 * max(n, m) and min(n - p, m - q) >= needed:
                pairs.append((u, v))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        shared = ngram_join._shared(spark.createDataFrame(rows, "g LONG, node LONG, n INT, pos INT"), 80)
        got = shared.toPandas()
    finally:
        spark.conf.set(key, before)
    assert isinstance(got, pd.DataFrame) and pairs and postings
    assert sorted(map(tuple, got[got.n > 0].values.tolist())) == sorted(postings)
    assert sorted(map(tuple, got[got.n == 0][["g", "node"]].values.tolist())) == sorted(pairs)
    assert got[got.n == -1].g.sum() == settled


def test_a_small_table_of_links_takes_few_queries(spark, monkeypatch):
    made, plain = [], components.frozen

    def counted(df, name, *args, **more):
        made.append(name)
        return plain(df, name, *args, **more)

    monkeypatch.setattr(components, "frozen", counted)
    # A path, the worst case for steps to the smallest neighbour, and a group beside it; one link comes twice, one node meets itself.
    links = [(k, k + 1) for k in range(0, 600, 2)] + [(k + 1, k) for k in range(1, 600, 2)] + [(-5, 900), (900, 901), (900, 901), (7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "u LONG, v LONG").coalesce(1)).collect()))
    assert got == dict.fromkeys(range(601), 0) | dict.fromkeys((-5, 900, 901), -5)
    assert len(made) <= 5
