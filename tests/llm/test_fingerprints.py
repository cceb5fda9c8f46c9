"""Fingerprints against a plain MinHash, edited texts against a plain order, near documents against all pairs."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from farelens.llm import fingerprints, queries
from tests.llm.test_operators import corpus, frame

COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def plain_signature(text, made):
    """Smallest a * x + b modulo 2 ** 32 over the shingles, in whole numbers of Python."""
    hashes = {int(x) >> 32 for x in made.shingles(text)}
    pairs = zip(made.times[:, 0].tolist(), made.plus[:, 0].tolist(), strict=True)
    return [min(((a * x + b) % (1 << 32) for x in hashes), default=0xFFFFFFFF) for a, b in pairs]


def plain_rows(rows, order, places):
    """Result rows for (doc_id, text) in the given order."""
    made = fingerprints.Fingerprinter(places)
    known = {}

    def signature(text):
        if text not in known:
            known[text] = plain_signature(text, made)
        return known[text]

    hexed = lambda s: "".join(f"{x:08x}" for x in s)
    like = lambda a, b: sum(x == y for x, y in zip(a, b)) / places
    out = []
    for k, at in enumerate(order):
        text, following = rows[at][1] or "", rows[order[(k + 1) % len(order)]][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed, near = signature(text), signature(edited), signature(following)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((rows[at][0], len(text), digest, hexed(own), hexed(changed), like(own, changed), like(own, near)))
    return Counter(out)


def test_shingles_are_those_of_the_words():
    made = fingerprints.Fingerprinter(8, 3)
    words = "a B\tc  d\n\x0ba b c Ünd".split()
    runs = {" ".join(words[k : k + 3]).replace("B", "b") for k in range(len(words) - 2)}
    assert len(set(made.shingles("a B\tc  d\n\x0ba b c Ünd").tolist())) == len(runs)
    assert set(made.shingles("A b c").tolist()) == set(made.shingles(" a  B\nC ").tolist())
    assert len(made.shingles("")) == len(made.shingles(" \t")) == 0 and len(made.shingles("x y")) == 1
    assert made.shingles("x y")[0] != made.shingles("x z")[0]


def test_likeness_estimates_jaccard():
    rng, made = random.Random(3), fingerprints.Fingerprinter(512)
    words = [str(rng.random()) for _ in range(3000)]
    for shared in (300, 1000, 2000, 2900):
        a, b = " ".join(words), " ".join(words[:shared] + [w + "x" for w in words[shared:]])
        x, y = set(made.shingles(a).tolist()), set(made.shingles(b).tolist())
        assert abs(len(x & y) / len(x | y) - fingerprints.likeness(made.signature(a), made.signature(b))) < 0.08


@pytest.mark.parametrize("ranges", [1, 4])
def test_edited_fingerprints(spark, monkeypatch, ranges):
    """Null ids, repeated rows, one id with several texts, empty and long texts; the order of hashes among equal ids is the library's."""
    monkeypatch.setattr(fingerprints, "RANGES", ranges)
    rows = [(i, t) for i, t, _ in corpus(3, 60)] + [(2, "another text of number two"), (-9, "x y"), (-9, "x y"), (-9, "x y")]
    docs = frame(spark, [(i, t, "s") for i, t in rows])
    keyed = docs.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS sig").distinct().collect()
    sigs = {(r["doc_id"], r["text"]): r["sig"] for r in keyed}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, sigs[rows[k][0], rows[k][1] or ""]))
    found = fingerprints.edited_fingerprints(docs, places=16)
    assert found.columns == COLUMNS
    assert Counter(map(tuple, found.collect())) == plain_rows(rows, order, 16)


def test_few_rows(spark):
    assert fingerprints.edited_fingerprints(frame(spark, [(1, "x", "s")]).limit(0)).count() == 0
    alone = fingerprints.edited_fingerprints(frame(spark, [(None, "a b c d", "s")]), places=8).first()
    assert alone["doc_id"] is None and alone["near_next"] == 1.0 and alone["n_chars"] == 7
    assert alone["edited_sha256"] == hashlib.sha256(b"a b a b").hexdigest()


def test_query_on_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = sorted((r["doc_id"], r["text"]) for r in table)
    found = queries.op12_fingerprints(spark, sf_dir).collect()
    expected = plain_rows(rows, range(len(rows)), fingerprints.PLACES)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in found) == expected
    equal = {}
    for r, (_, text) in zip(sorted(found, key=lambda r: r["doc_id"]), rows, strict=True):
        assert equal.setdefault(text, r["fingerprint"]) == r["fingerprint"]


def test_fingerprints_of_rows(spark):
    rows = corpus(5, 20)
    made = fingerprints.Fingerprinter(8)
    found = Counter(map(tuple, fingerprints.fingerprints(frame(spark, rows), places=8).collect()))
    assert found == Counter((i, made.signature(t or "").astype("<u4").tobytes()) for i, t, _ in rows)


@pytest.mark.parametrize("full", [0, 4])
def test_near_documents(spark, monkeypatch, full):
    """Links of all pairs, in rounds of pivots only (full = 0) and with the rest compared at once."""
    monkeypatch.setattr(fingerprints, "FULL", full)
    rows = [(i, t) for i, t, _ in corpus(6, 80)]
    rng = random.Random(8)
    base = [f"v{rng.randrange(500)}" for _ in range(120)]
    for k in range(25):
        other = list(base)
        for _ in range(rng.randrange(1, 6)):
            other[rng.randrange(120)] = f"n{rng.randrange(9000)}"
        rows.append((500 + k, " ".join(other)))
    made = fingerprints.Fingerprinter(1)
    sets = [set(made.shingles(t or "").tolist()) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    root = {k: k for k in order}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    rank = {k: n for n, k in enumerate(order)}
    for a in order:
        for b in order:
            if rank[a] < rank[b] and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)), key=rank.get)
                root[y] = x
    found = Counter(map(tuple, fingerprints.near_documents(frame(spark, [(i, t, "s") for i, t in rows])).collect()))
    assert found == Counter((rows[k][0], rows[find(k)][0]) for k in range(len(rows)))
    assert fingerprints.near_documents(frame(spark, [(1, "x", "s")]).limit(0)).count() == 0
    assert np.isclose(1 - (1 - 0.8**4) ** 32, 1.0, atol=1e-7)
