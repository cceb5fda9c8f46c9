"""What a search for near vectors costs: distances worked out, and vectors looked at, for each query."""

from __future__ import annotations

import numpy as np

from farelens.llm import vectors
from farelens.llm.hnsw import NEIGHBOURS, Graph


def unit_rows(seed, n, dims=24):
    unit = np.random.default_rng(seed).normal(size=(n, dims)).astype(np.float32)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def with_copies(unit, at, n, seed=1):
    """The rows and ``n`` near copies of one of them."""
    unit = np.vstack([unit, unit[at] + 0.01 * unit_rows(seed, n, unit.shape[1])])
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def shard(unit):
    return vectors._Shard(np.arange(len(unit)) + 7, unit, np.ones(len(unit), int), 0.9, 3)


def test_a_search_meets_a_node_once(monkeypatch):
    """Distances to nodes that left the beam are not worked out a second time, and an answer names a node once."""
    graph, queries = Graph(unit_rows(1, 3000)), unit_rows(2, 100)
    met, plain = [], np.einsum

    def counted(how, *args, **more):
        out = plain(how, *args, **more)
        met.append(out.size)
        return out

    monkeypatch.setattr(np, "einsum", counted)
    ids, sims = graph.search(queries, 32)
    # Old steps worked out all four lists of neighbours, met before or not.
    assert 32 * len(queries) < sum(met) < 0.8 * 32 * 2 * NEIGHBOURS * len(queries)
    assert all(len(set(row)) == 32 for row in ids.tolist())
    true = (queries[:, None] * graph.unit[ids]).sum(2)
    assert np.allclose(sims, true, atol=1e-5) and (np.diff(sims, axis=1) <= 0).all()


def test_tables_name_a_neighbour_once():
    """Also where two nodes of a block choose each other; what is there lies to the left."""
    for table in Graph(with_copies(unit_rows(3, 700), 0, 200)).layers:
        for row in table.tolist():
            named = [k for k in row if k >= 0]
            assert len(set(named)) == len(named) and row[: len(named)] == named


def test_full_beams_are_scanned_and_no_others(monkeypatch):
    """A group larger than the beam is found whole by scans of its own queries; the beam of the others stays."""
    unit = with_copies(unit_rows(4, 1000), 5, 299)
    one = shard(unit)
    scanned, plain = [], vectors._Shard._scan

    def counted(self, part):
        scanned.append(len(part))
        return plain(self, part)

    monkeypatch.setattr(vectors._Shard, "_scan", counted)
    rows = one.join_own()
    group = [5, *range(1000, 1299)]
    assert [(c, r) for _, c, r in rows] == [(299, [12]) if k in group else (0, []) for k in range(1299)]
    # 299 copies and their original, and one query in sixteen that is audited.
    assert one.beam == vectors.BEAM and sum(scanned) <= 300 + 1299 // vectors.AUDITED + 6 * vectors.AUDITED


def test_blocks_that_miss_links_are_scanned(monkeypatch):
    """A search that finds nothing: audits see it, scans find all links, and the beam widens once 100 links were seen."""
    unit = with_copies(unit_rows(5, 600), 9, 200)
    one = shard(unit)
    monkeypatch.setattr(one.graph, "search", lambda q, beam: (np.full((len(q), beam), -1, np.int32), np.full((len(q), beam), -2, np.float32)))
    found = one.links(unit[600:].astype(float), np.arange(600, 800))
    assert [len(places) for places in found] == [200] * 200 and one.beam == 2 * vectors.BEAM
    one = shard(np.vstack([unit_rows(6, 600), unit_rows(6, 600)[:1]]))
    monkeypatch.setattr(one.graph, "search", lambda q, beam: (np.full((len(q), beam), -1, np.int32), np.full((len(q), beam), -2, np.float32)))
    assert [p.tolist() for p in one.links(one.exact[:1], np.array([0]))] == [[600]] and one.beam == vectors.BEAM


def test_scans_hold_a_piece_at_once(monkeypatch):
    unit = with_copies(unit_rows(7, 500), 3, 100)
    one = shard(unit)
    whole = one._scan(unit[400:])
    monkeypatch.setattr(vectors, "SCANNED", 1000)
    assert [a.tolist() for a in one._scan(unit[400:])] == [a.tolist() for a in whole]
    assert [a.tolist() for a in whole] == [np.flatnonzero(unit @ q >= 0.9).tolist() for q in unit[400:]]


def test_vectors_are_packed_without_python_numbers(spark):
    """Also from slices of a batch, whose lists do not begin at their first number."""
    odd = [None, [], [0.0, 0.0], [float("nan"), 1.0], [None, 1.0], [float("-inf")], [-0.0, 2.0], [0.0, 2.0], [1e-45], [3.0] * 5]
    for kind, dtype in (("FLOAT", "<f4"), ("DOUBLE", "<f8"), ("INT", "<f8")):
        lists = [[k] * (k % 4) for k in range(30)] if kind == "INT" else odd * 3
        table = spark.createDataFrame(list(enumerate(lists)), f"vec_id LONG, embedding ARRAY<{kind}>").coalesce(1)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        try:
            got = [None if r["vec"] is None else bytes(r["vec"]) for r in vectors._vectors(table, dtype).orderBy("b").collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        plain = [np.array([np.nan if y is None else y for y in v or []], dtype) for v in lists]
        assert got == [(x + 0).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None for x in plain]
