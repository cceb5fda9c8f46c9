"""Stages of the corpus pipeline against plain versions, and the registered queries."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from farelens.llm import queries as registered
from tests.conftest import SF_DIR
from tests.llm import brute
from tests.llm.test_operators import frame


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(spark, docs):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF_DIR)
        assert now.schema.names == docs.schema.names, name
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0, name


def test_toxic_documents_go(spark, docs):
    kept = {r[0] for r in rows_of(corpus_pipeline.drop_toxic(spark, docs, SF_DIR))}
    scores = registered.op4_toxicity(spark, SF_DIR).collect()
    assert kept == {r["doc_id"] for r in scores if r["predicted"] == 0}


def test_line_stage(spark, docs):
    got = Counter(rows_of(corpus_pipeline.drop_repeated_lines(spark, docs, SF_DIR)))
    assert got == Counter((i, kept) for i, _, _, kept in brute.lines(rows_of(docs)))


def test_near_duplicate_stage(spark, docs):
    got = {r[0] for r in rows_of(corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR))}
    assert got == {i for i, _, c in brute.jaccard_components(rows_of(docs), 5, 80) if i == c}


def test_near_duplicate_stage_tells_rows_apart(spark):
    """Null ids, an id with two texts, and repeated rows: one row of each component stays, unrelated rows of the same id too."""
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(40))
    near = lambda k: text(k) + " more"
    rows = [(1, text(1)), (None, near(1)), (None, text(2)), (None, text(3)), (2, text(4)), (3, text(5)), (3, near(4)), (3, near(5))]
    rows += [(4, text(6))] * 3 + [(None, text(7))] * 2 + [(None, ""), (None, ""), (5, None)]
    docs = frame(spark, [(i, t, "s") for i, t in rows])
    got = Counter(rows_of(corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR)))
    either = [t for i, t in got if i == 3]
    assert len(either) == 1 and either[0] in (text(5), near(5))
    whole = [(1, text(1)), (None, text(2)), (None, text(3)), (2, text(4)), (3, either[0]), (4, text(6)), (None, text(7))]
    assert got == Counter(whole + [(None, ""), (None, ""), (5, None)])


def test_mixing_stage(spark, docs):
    before, after = Counter(rows_of(docs)), Counter(rows_of(corpus_pipeline.mix_sources(spark, docs, SF_DIR)))
    assert set(after) <= set(before) and max(after.values()) <= 2
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in registered.op5_source_mixing(spark, SF_DIR).collect()}
    assert all(taken[i][1] > 0 or taken[i][0] == 0 for i, _ in after)


def test_mixing_stage_shares_copies_of_equal_rows(spark, monkeypatch):
    """Three copies over two rows, one over three, none, a source of its own for equal rows, and rows without words."""
    rows = [(1, "a", "s"), (1, "a", "s"), (2, "b", "s"), (2, "b", "s"), (2, "b", "s"), (3, "c", "s"), (3, "c", None), (None, "", None)]
    given = {("s", "a"): 3, ("s", "b"): 1, ("s", "c"): 0, (None, "c"): 2, (None, ""): 1}
    docs = frame(spark, rows)

    class Drawn(corpus_pipeline.mixing.Mixture):
        def pieces(self):
            """What the mix takes first words of, dealt to the equal rows in order of their places."""
            named = self.docs.join(self.sources.select("source", "source_no"), "source_no").collect()
            texts = {(r["b"], r["sig"]): r["text"] for r in corpus_pipeline._packed(docs).select("b", "sig", "_row.text").collect()}
            first = {}
            for r in sorted(named, key=lambda r: r["start"]):
                if r["size"]:
                    first.setdefault((r["source"], texts[r["b"], r["sig"]]), (r["source_no"], r["start"]))
            taken = [(*at, 0, 1) for key, at in first.items() for _ in range(given[key])]
            return spark.createDataFrame(taken, "source_no INT, start LONG, first LONG, n_words LONG")

    monkeypatch.setattr(corpus_pipeline.mixing, "Mixture", Drawn)
    got = Counter((r["source"], r["text"]) for r in corpus_pipeline.mix_sources(spark, docs, SF_DIR).collect())
    assert got == Counter(given)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF_DIR)
    rows = got.collect()
    assert rows and all(len(r["ids"]) == 4 * r["n_tokens"] for r in rows)


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    result = con.execute(registered.oracle_sql()[name])
    names = [d[0] for d in result.description]
    found = registered.queries()[name](spark, SF_DIR)
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(tuple, found.select(*names).collect()), key=repr) == sorted(result.fetchall(), key=repr)
