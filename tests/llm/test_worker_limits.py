"""What a Python worker holds, and how the n-grams of a pack are numbered."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from farelens.llm import ngram_join, quality
from farelens.llm.common import frozen


def test_positions_are_numbered_without_sorting_them(monkeypatch):
    rng = random.Random(5)
    texts = ["", "a", "日本 \ud800", *["".join(rng.choice("abc é") for _ in range(rng.randrange(60))) for _ in range(50)]]
    padded = [quality.BEGIN * 2 + text + quality.END for text in texts]
    at = [text[k : k + 3] for text in padded for k in range(len(text) - 2)]
    monkeypatch.setattr(np, "unique", None)
    grams, hashes, number, first = quality._grams(texts, 3)
    assert sorted(grams) == sorted(set(at)) and len(hashes) == len(grams)
    assert [grams[k] for k in number] == at
    assert (hashes[:-1] < hashes[1:]).all()
    starts = [0]
    for text in texts[:-1]:
        starts.append(starts[-1] + len(text) + 1)
    assert first.tolist() == starts
    assert quality._grams([], 3)[0] == []


def test_batches_for_python_are_bounded_in_bytes(spark):
    def count(batches):
        for pdf in batches:
            yield pd.DataFrame({"rows": [len(pdf)]})

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    texts = spark.range(400).selectExpr("repeat('x', 10000) AS text").coalesce(1)
    held = [r["rows"] for r in frozen(texts.mapInPandas(count, "rows long"), "rows", batch=500_000).collect()]
    assert sum(held) == 400 and max(held) < 100
    assert spark.conf.get(name, None) == before


def test_texts_reach_the_join_in_small_batches(spark, monkeypatch):
    asked = {}

    def seen(df, name, *args, **more):
        asked.setdefault(name, set()).add(more.get("batch"))
        return frozen(df, name, *args, **more)

    monkeypatch.setattr(ngram_join, "frozen", seen)
    rows = [(k, "one two three four five six seven eight nine ten" + " more" * (k % 2)) for k in range(6)]
    found = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id LONG, text STRING"), 2, 80).collect()
    assert {r["component_id"] for r in found} == {0}
    assert {name: asked[name] for name in ("sets", "postings", "links")} == dict.fromkeys(("sets", "postings", "links"), {ngram_join.BATCH_BYTES})


@pytest.mark.parametrize("width", [1, 3])
def test_kept_words_are_bounded(monkeypatch, width):
    monkeypatch.setattr(ngram_join, "MAX_WORDS", 7)
    hashes, plain = ngram_join._WordHashes(), ngram_join._WordHashes()
    texts = [" ".join(f"w{(k * j) % 40}" for j in range(30)) for k in range(9)]
    made = [ngram_join.shingle_set(text, width, hashes) for text in texts]
    assert len(hashes) <= 7
    monkeypatch.undo()
    assert all(np.array_equal(a, ngram_join.shingle_set(text, width, plain)) for a, text in zip(made, texts, strict=True))
