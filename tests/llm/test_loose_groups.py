"""A group of near copies of which only some link with each other."""

from __future__ import annotations

import random

from farelens.llm import ngram_join


def test_middle_of_a_loose_group_is_found_at_once(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"base{k}" for k in range(150)]
    rows = []
    for k in range(400):
        words = list(base)
        # A word of its own sets a copy apart by eight shingles; two that link differ by 22 at most.
        for place in rng.sample(range(150), min(k, 1 + k % 4)):
            words[place] = f"own{k}x{place}"
        rows.append((k, " ".join(words)))
    compared, rest = [], ngram_join._rest_pairs

    def counted(*args):
        found = rest(*args)
        compared.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "_rest_pairs", counted)
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs, 4, 85).collect()}
    assert found == brute_components(rows)
    assert sum(compared) <= 4 * len(rows)


def brute_components(rows):
    sets = {k: {tuple(w[i : i + 4]) for w in [text.split()] for i in range(len(w) - 3)} for k, text in rows}
    least = {k: k for k in sets}

    def top(k):
        while least[k] != k:
            k = least[k]
        return k

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                least[y] = x
    return {k: top(k) for k in sets}
