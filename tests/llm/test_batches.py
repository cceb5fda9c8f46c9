"""Texts are taken in small batches, however many rows Spark hands over at once."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pytest

from farelens.llm import byte_bpe, toxicity
from farelens.llm.common import BATCH_BYTES, small_batches

LARGE = (1 << 60) + 1


@pytest.fixture
def batch():
    texts = [None, "", *[f"You stupid moron number {k}! " * 400 for k in range(600)]]
    ids = [None, LARGE, *range(600)]
    toxic = [float(k % 2) for k in range(len(texts))]
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts), "toxic": toxic})


def test_slices_hold_all_rows_in_order(batch):
    made = list(small_batches([batch, batch.slice(0, 0)]))
    assert pa.Table.from_batches(made) == pa.Table.from_batches([batch])
    assert max(part.nbytes for part in made) < 1.5 * BATCH_BYTES
    assert [part.num_rows for part in small_batches([batch.slice(0, 3)], 1)] == [1, 1, 1]


def test_encoded_texts_come_in_small_batches(batch):
    enc = byte_bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    made = list(byte_bpe.encoded_batches([batch], enc, True))
    rows = pa.Table.from_batches(made).to_pydict()
    assert len(made) > 2 and max(part.num_rows for part in made) < 300
    assert rows["doc_id"] == batch.column("doc_id").to_pylist()
    assert rows["decoded"] == [(text or "").encode() for text in batch.column("text").to_pylist()]


def test_features_and_entries_come_in_small_batches(batch):
    made = list(toxicity._feature_batches([batch], {"moron": 5.0}, ["doc_id"]))
    rows = pa.Table.from_batches(made).to_pydict()
    assert len(made) > 2 and rows["doc_id"] == batch.column("doc_id").to_pylist()
    weights = toxicity._Weights({"moron": 5.0})
    assert rows["f"] == [toxicity.features(text or "", weights) for text in batch.column("text").to_pylist()]
    counted = list(toxicity._entry_batches([batch.slice(1)]))
    rows = pa.Table.from_batches(counted).to_pylist()
    assert len(counted) > 2
    assert [sum(row[c] for row in rows if row["entry"] == "moron") for c in ("p", "q")] == [300, 300]


def test_kept_log_odds_are_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_WORDS", 7)
    weights = toxicity._Weights({"w3": 1.0, "w3aa~": 2.0})
    assert [weights[f"w{k}"] for k in range(40)] == [1.0 if k == 3 else 0.0 for k in range(40)]
    assert weights["w3aabc"] == 2.0 and len(weights) <= 7


def test_large_ids_beside_null_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (LARGE, "b")], "doc_id long, text string").coalesce(1)
    found = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert {row["doc_id"] for row in found.collect()} == {None, LARGE}
