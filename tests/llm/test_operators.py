"""Corpus operators against plain versions, with nulls, ties, repeats, empty tables, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from farelens.llm import byte_bpe, common, exact_dedup, line_dedup, mixing, ngram_join, quality, sharding, token_counts, toxicity, vectors
from farelens.llm.components import components
from farelens.llm.cuckoo import CuckooIndex
from farelens.llm.hnsw import Graph
from farelens.llm.queries import oracle_sql
from farelens.llm.transducer import from_json
from tests.llm import brute

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, key STRING, salt STRING, b STRING, kept STRING, component STRING"


def frame(spark, rows):
    """Documents with columns that operators use names of."""
    full = [(i, t, "en", s, "k", "s", "b", "kept", "c") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def corpus(seed=1, n=120):
    """Near copies, exact copies, shared lines, nulls, empty texts, ties, repeated rows and one long text."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["Über", "ñandú", "日本", "The"]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [line(12) for _ in range(4)]
    texts = ["\n".join([line(rng.randrange(5, 30)) for _ in range(rng.randrange(1, 6))]) for _ in range(n)]
    for k in range(0, n, 7):
        base = texts[k].split(" ")
        if len(base) > 40:
            base[rng.randrange(len(base))] = "changed"
            texts.append(" ".join(base))
        texts.append(texts[k] + " \t")
        texts.append(texts[k].upper())
        texts[k] += "\n  " + rng.choice(shared).upper() + "\n" + rng.choice(shared)
    texts += [None, "", " \n\t", "one", "one two", "ONE  two", "a\n\n\nb", line(40_000)]
    rows = [(k, t, f"s{k % 3}" if k % 5 else None) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, rows[4][1], "s1"), (None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).cache()


def plain(rows):
    return [(i, t) for i, t, _ in rows]


def as_sorted(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_exact_duplicates(spark, docs):
    got = as_sorted(exact_dedup.exact_duplicates(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(brute.exact(plain(corpus())), key=repr)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_exact_index_is_reversible(spark):
    rows = list({r[0]: r for r in corpus(2, 40) if r[0] is not None}.values())
    first, second = frame(spark, rows[::2]), frame(spark, rows[1::2])
    index = exact_dedup.ExactIndex(1000)
    index.insert(first)
    before = as_sorted(index.live(), "text_sha256", "group_size", "keep_id")
    index.insert(second)
    both = as_sorted(index.live(), "text_sha256", "group_size", "keep_id")
    assert both == sorted({(h, n, k) for _, k, n, _, h in brute.exact(plain(rows))}, key=repr)
    index.delete(second.select("doc_id"))
    assert as_sorted(index.live(), "text_sha256", "group_size", "keep_id") == before


def test_cuckoo_filter_overflows_and_deletes():
    index, rng = CuckooIndex(), random.Random(4)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for key in keys:
        index.add(key, 1, 0, 5, 5)
        if rng.random() < 0.3:
            index.add(key, 1, 0, 3, 3)
    assert index.buckets > 8 and all(index.find(k) >= 0 for k in keys)
    assert index.find(hashlib.sha256(b"other").digest()) == -1
    # A key that shares a fingerprint and bucket is told apart by its content.
    twin = keys[0][:10] + b"\0" * 22
    assert index.find(twin) == -1
    for key in keys[::2]:
        assert index.delete(key)
    assert all((index.find(k) >= 0) == bool(i % 2) for i, k in enumerate(keys))


def test_repeated_lines(spark, docs):
    found = line_dedup.drop_repeated_lines(docs)
    assert found.columns == [*docs.columns, "_lines"]
    got = as_sorted(found, "doc_id", "_lines.n_lines", "_lines.n_dropped", "_lines.kept")
    assert got == sorted(brute.lines(plain(corpus())), key=repr)
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_repeated_lines_of_rows_without_id(spark):
    """Each text without doc_id is a document: what repeats among them stays once, and not at all where a numbered one holds it."""
    shared, taken, alone = "a line of many", "a line of number one", "a line of its own, "
    texts = [f"{alone}{k}\n{shared}\n{taken}" for k in range(6)] + [f"{alone}x\n{alone}x"]
    rows = [(1, taken, "s"), *((None, t, "s") for t in texts), (None, texts[0], "s"), (-7, "other text here", "s")]
    got = as_sorted(line_dedup.drop_repeated_lines(frame(spark, rows)), "doc_id", "_lines.kept")
    with_shared = {kept for i, kept in got if i is None and shared in kept}
    assert len(with_shared) == 1
    first = next(k for k in range(6) if f"{alone}{k}\n{shared}" in with_shared)
    kept = [f"{alone}{k}\n{shared}" if k == first else f"{alone}{k}" for k in (*range(6), 0)]
    wanted = [(1, taken), (-7, "other text here"), (None, texts[6]), *((None, t) for t in kept)]
    assert Counter(got) == Counter(wanted)


def test_line_index_is_reversible(spark):
    rows = list({r[0]: r for r in corpus(3, 40) if r[0] is not None}.values())
    first, second = frame(spark, rows[::2]), frame(spark, rows[1::2])
    index = line_dedup.LineIndex(10_000)
    index.insert(first)
    before = as_sorted(index.counts(), "key", "refs", "first_id")
    index.insert(second)
    assert as_sorted(index.counts(), "key", "refs", "first_id") != before
    index.delete(second.select("doc_id"))
    assert as_sorted(index.counts(), "key", "refs", "first_id") == before


@pytest.mark.parametrize("width, threshold", [(4, 85), (5, 80), (2, 50)])
def test_ngram_components(spark, docs, width, threshold):
    got = as_sorted(ngram_join.ngram_components(docs, width, threshold), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.jaccard_components(plain(corpus()), width, threshold), key=repr)
    assert ngram_join.ngram_components(docs.limit(0), width, threshold).count() == 0


def test_ngram_components_of_a_large_group(spark):
    """Near copies of one text, each a little different, and chains whose ends are not similar."""
    rng = random.Random(8)
    base = [f"v{k}" for k in range(80)]
    rows = []
    for k in range(150):
        own = list(base)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(own), "s"))
    chain = [f"c{k}" for k in range(60)]
    rows += [(1000 + k, " ".join(f"n{k}_{j}" if j < k else c for j, c in enumerate(chain)), "s") for k in range(8)]
    got = as_sorted(ngram_join.ngram_components(frame(spark, rows), 4, 85), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.jaccard_components(plain(rows), 4, 85), key=repr)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(k, k + 1) for k in range(1000, 1040)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u LONG, v LONG")).collect()))
    roots = brute.union_find(1041, links)
    assert got == {k: roots[k] for k in {x for a, b in links if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "u LONG, v LONG")).count() == 0


SPECIAL = [
    "", " ", "  a  b ", "don't can't I'll we've they're it's 'tis ''s x'y", "a\n\n b\t\tc  \n", "１２ ２a3 Ⅷ²", "日本語のテキスト。",
    "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|>", "naïve é ß 👩‍👩‍👧 ​\x1c\x85", "!!!'s  'll\n'", " " * 70 + "x", "z" * 3000,
]


def test_transducer_counts_like_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    machine, lib = from_json(path), Tokenizer.from_file(path)
    rng = random.Random(6)
    pieces = ["a", "'s", "'", "re", "ve", "'ll", " ", "  ", "\n", "1", "é", "日", "!", " ", "the", " and", " ", "😀"]
    texts = SPECIAL + ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(3000)]
    for text in texts:
        assert machine.count(text) == len(lib.encode(text, add_special_tokens=False).ids), repr(text)


def test_chunk_maps_compose_in_any_grouping():
    machine = from_json(public_tokenizers.path("byte_bpe_50k.json"))
    text = "".join(SPECIAL) * 3
    for size in (1, 3, 17, 200):
        maps = [token_counts.chunk_map(text[k : k + size], machine) for k in range(0, len(text), size)]
        left = maps[0]
        for m in maps[1:]:
            left = token_counts.compose(left, m, machine)
        while len(maps) > 1:
            pairs = [maps[k : k + 2] for k in range(0, len(maps), 2)]
            maps = [token_counts.compose(*p, machine) if len(p) == 2 else p[0] for p in pairs]
        assert token_counts.map_total(left, machine) == token_counts.map_total(maps[0], machine) == machine.count(text)


def test_token_counts(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = plain(corpus()) + [(5000 + k, t) for k, t in enumerate(SPECIAL)]
    table = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    count = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    wanted = sorted(((i, len((t or "").encode()), count(t)) for i, t in rows), key=repr)
    assert as_sorted(token_counts.token_counts(table, path), "doc_id", "n_bytes", "n_tokens") == wanted
    # Nearly every text in chunks.
    assert as_sorted(token_counts.token_counts(table, path, 100, 50), "doc_id", "n_bytes", "n_tokens") == wanted
    assert token_counts.token_counts(table.limit(0), path).count() == 0


def test_byte_bpe(spark, docs):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    enc = byte_bpe.encoding(path, pattern)
    rows = plain(corpus()) + [(5000 + k, t) for k, t in enumerate(SPECIAL)]
    table = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = byte_bpe.round_trip(table, path, pattern).collect()
    wanted = Counter((i, np.asarray(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == wanted
    decoded = byte_bpe.encode(table, path, pattern).select(byte_bpe.decode(F.col("ids"), path, pattern).alias("d"))
    assert Counter(bytes(r["d"]) for r in decoded.collect()) == Counter((t or "").encode() for _, t in rows)
    assert byte_bpe.encode(table.limit(0), path, pattern).count() == 0
    assert isinstance(enc, tiktoken.Encoding)


def test_safe_pieces():
    enc = byte_bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = " ".join(SPECIAL) * 4
    for points in (1, 5, 50):
        pieces = list(byte_bpe.safe_pieces(text, points))
        assert "".join(pieces) == text and len(pieces) > 3
        assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_equal_rows_in_the_mix(spark, monkeypatch):
    """One text without doc_id is half of all rows: its rows lie end to end, each in a place of its own."""
    monkeypatch.setattr(mixing, "GROUP_ROWS", 7)
    rows = [(None, "a b c", "s")] * 100 + [(k, "x " * (k % 5), "s" if k % 2 else "t") for k in range(100)] + [(None, "a b c", "t")] * 9
    docs = mixing.Mixture(frame(spark, rows), block_words=8).docs.collect()
    assert len(docs) == len(rows)
    for number in {r["source_no"] for r in docs}:
        placed = sorted((r["start"], r["size"]) for r in docs if r["source_no"] == number and r["size"])
        ends = [start + size for start, size in placed]
        assert [start for start, _ in placed] == [0, *ends[:-1]]
    assert Counter((r["size"], r["start"]) for r in docs if r["size"] == 3).most_common(1)[0][1] <= 2


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 400)), f"s{min(k % 9, 6)}" if k % 11 else None) for k in range(600)]
    rows += [(700, None, "s1"), (701, " \n", None), rows[5], (None, "a b c", "s2")]
    table = frame(spark, rows)
    got = mixing.Mixture(table).taken().collect()
    again = mixing.Mixture(table.repartition(5)).taken().collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    sizes: Counter = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    wanted = brute.targets(dict(sizes))
    # No two sources are of one size here, so a source is known by it.
    taken: Counter = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"]] += r["taken"]
    for s, n in sizes.items():
        own = {r["target"] for r in got if r["source_size"] == n}
        assert [*own] == [pytest.approx(wanted[s])]
        assert abs(taken[n] - wanted[s]) <= 0.5 * mixing.BLOCK_WORDS + 0.02 * wanted[s]
    assert mixing.Mixture(table.limit(0)).taken().count() == 0
    only_empty = mixing.Mixture(frame(spark, [(1, None, "a"), (2, "", None)])).taken()
    assert as_sorted(only_empty, "doc_id", "size", "taken") == [(1, 0, 0), (2, 0, 0)]


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long")).alias("p")).collect()
        places = [r["p"] for r in got]
        assert sorted(places) == list(range(n)) and (n < 100 or places != list(range(n)))


def test_sharding_sql_where_buckets_split(spark):
    """The registered SQL, which knows no shard above its limit, with limits at which buckets split; the longest text has 19,535 bytes."""
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    sql = oracle_sql()["op10_sharding"]
    for limit in (20_000, 60_000):
        assert str(sharding.LIMIT) in sql
        wanted = con.execute(f"SELECT doc_id, n_bytes, shard, depth, shard_bytes, oversized FROM ({sql.replace(str(sharding.LIMIT), str(limit))})")
        got = sharding.shard_rows(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), limit)
        rows = [tuple(r) for r in got.select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "oversized").collect()]
        assert sorted(rows) == sorted((a, b, c, d, int(e), f) for a, b, c, d, e, f in wanted.fetchall())
        assert len({r[2] for r in rows}) > 2


def test_shards_of_a_table_with_such_a_column(spark, tmp_path):
    table = frame(spark, [(k, "x" * 50, "s") for k in range(40)]).withColumn("Shard", F.lit("mine"))
    sharding.write_shards(table, str(tmp_path / "out"), 200)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.filter("Shard = 'mine'").count() == 40 and back.select("shard_").distinct().count() > 4


def test_sharding(spark, tmp_path):
    rows = corpus(9, 200)
    table = frame(spark, rows)
    sizes = Counter()
    got = sharding.shard_rows(table, 4000).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == Counter((i, len((t or "").encode())) for i, t, _ in rows)
    for r in got:
        sizes[r["shard"]] += r["n_bytes"]
    assert all(sizes[r["shard"]] == r["shard_bytes"] and r["depth"] == len(r["shard"]) for r in got)
    over = [r for r in got if r["oversized"]]
    assert over and all(r["n_bytes"] > 4000 for r in over)  # the one long text
    names = sorted(sizes)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    # A shard's sibling side would not have fitted: no bucket split without need.
    for name in names:
        if name:
            assert sum(n for s, n in sizes.items() if s.startswith(name[:-1])) > 4000
    one = sharding.shard_rows(table, 1 << 40).select("shard").distinct().collect()
    assert [r["shard"] for r in one] == [""]
    assert sharding.shard_rows(table.limit(0), 10).count() == 0
    sharding.write_shards(table, str(tmp_path / "out"), 4000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and back.select("shard").distinct().count() == len(names)


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 16))
    rows = [base[k] for k in range(150)]
    rows += [base[k % 20] + rng.normal(size=16) * rng.choice([0.05, 0.3, 0.5]) for k in range(200)]
    rows += [base[0] + rng.normal(size=16) * 0.02 for _ in range(120)] + [base[1]] * 30 + [base[2] * 3]
    vectors_ = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(rows)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    vectors_ += [(900 + k, v) for k, v in enumerate(odd)] + [vectors_[0], (None, vectors_[3][1])]
    table = spark.createDataFrame([(i, v, "x") for i, v in vectors_], "vec_id LONG, embedding ARRAY<FLOAT>, node STRING").repartition(4)
    got = vectors.near_vectors(table, 0.9)
    assert as_sorted(got, "vec_id", "n_links", "component_id") == sorted(brute.cosine_links(vectors_, 0.9), key=repr)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.collect())
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(3000, 24)).astype(np.float32)
    unit[500:900] = unit[0] + rng.normal(size=(400, 24)).astype(np.float32) * 0.1  # a dense group
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    graph, queries = Graph(unit), unit[::20]
    ids, _ = graph.search(queries, 128)
    truth = np.argsort(-(queries @ unit.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids.tolist(), truth.tolist(), strict=True)]) >= 0.9


def test_toxicity(spark):
    rng = random.Random(10)
    words = [f"word{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(900):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        toxic = int(k % 5 == 0)
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["grobian", "grobianisch", "flegel", "idiot"]))
        rows.append((k, " ".join(text), "s"))
        labels.append((k, 1, toxic))
    rows += [(None, "you idiot", "s"), (2000, None, "s"), (2001, "", None), rows[1]]
    labels += [(1, 1, labels[1][2]), (None, 1, 1), (5, 1, None), (7, 1, 3)]
    label_frame = spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT")
    got = toxicity.toxicity_scores(frame(spark, rows), label_frame).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held]) > 0.97
    empty = {r["score"] for r in got if r["doc_id"] in (2000, 2001)}
    assert len(empty) == 1
    unlabelled = toxicity.toxicity_scores(frame(spark, rows), label_frame.limit(0)).select("score").distinct().collect()
    assert [r["score"] for r in unlabelled] == [0.0]
    assert toxicity.toxicity_scores(frame(spark, rows).limit(0), label_frame).count() == 0


@pytest.mark.parametrize("n_toxic", [1, 3])
def test_toxicity_learns_from_few_labels(spark, n_toxic):
    import zlib

    learnable = [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 != 2]
    rows = [(k, f"calm words of number {k} on a quiet day", "s") for k in learnable]
    toxic = learnable[:n_toxic]
    rows = [(k, f"you idiot, damned idiot {k}!!!" if k in toxic else t, s) for k, t, s in rows]
    labels = spark.createDataFrame([(k, int(k in toxic)) for k in learnable], "doc_id LONG, toxic INT")
    docs = frame(spark, rows)
    model = toxicity.ToxicityModel(docs, labels)
    assert model.trees is not None and 0 < model.base < 0.1
    assert model.score(docs).count() == len(rows)
    if n_toxic == 3:
        dealt = toxicity._dealt(toxicity._sample(docs, labels, 1000)).groupBy("part", "toxic").count()
        assert dealt.count() == 6


def plain_kneser_ney(texts, order):
    """Probability function of a character model, straight from the definition."""
    padded = ["\x02" * (order - 1) + t + "\x03" for t in texts]
    counts = {order: Counter(t[k : k + order] for t in padded for k in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount = {}
    for k, c in counts.items():
        n = Counter(c.values())
        if all(n[j] for j in (1, 2, 3)):
            y = n[1] / (n[1] + 2 * n[2])
            discount[k] = [min(max(j - (j + 1) * y * n[j + 1] / n[j], 0.0), float(j)) for j in (1, 2, 3)]
        else:
            discount[k] = [0.5, 1.0, 1.5]

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        followers = {g: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
        total = sum(followers.values())
        if not total:
            return p(gram[1:])
        d = lambda c: discount[k][min(c, 3) - 1] if c else 0.0
        left = sum(min(d(c), c) for c in followers.values()) / total
        own = followers.get(gram, 0)
        return max(own - d(own), 0.0) / total + left * p(gram[1:])

    return p


def test_kneser_ney_perplexity(spark):
    rng = random.Random(12)
    make = lambda: " ".join(rng.choice(["abba", "baba", "abc", "caab", "b"]) for _ in range(rng.randrange(1, 9)))
    rows = [(k, make(), "s") for k in range(40)] + [(100, None, "s"), (101, "zzz QQ 9", "s"), (None, "abc", "s"), (3, "abc abc", None)]
    labels = spark.createDataFrame([(k, int(k < 20), 0) for k in range(30)], "doc_id LONG, quality INT, toxic INT")
    got = quality.quality_filter(frame(spark, rows), labels, order=3).collect()
    learnt, measured = ({r["b"] for r in part.collect()} for part in quality.trusted_documents(labels))
    assert learnt | measured == set(range(20)) and not learnt & measured and measured
    p = plain_kneser_ney([quality.normal(t or "") for i, t, _ in rows if i in learnt], 3)
    wanted = Counter()
    for i, t, _ in rows:
        padded = "\x02\x02" + quality.normal(t or "") + "\x03"
        logs = [np.log(p(padded[k : k + 3])) for k in range(len(padded) - 2)]
        wanted[(i, round(float(np.exp(-np.mean(logs))), 3))] += 1
    assert Counter((r["doc_id"], round(r["perplexity"], 3)) for r in got) == wanted
    assert all(r["kept"] == (r["perplexity"] <= r["threshold"]) for r in got)
    nothing_trusted = quality.quality_filter(frame(spark, rows), labels.limit(0), order=3)
    assert nothing_trusted.filter("kept").count() == len(rows)
    assert quality.quality_filter(frame(spark, rows).limit(0), labels, order=3).count() == 0


def test_good_texts_that_nobody_labelled_stay(spark):
    """Of good texts without a label as many stay as of trusted ones; noise goes. The threshold knows no text that trained the model."""
    rng = random.Random(21)
    syllables = [a + b for a in "bdklmnrst" for b in "aeiou"]
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    good = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(20, 60)))
    noise = lambda: "".join(rng.choice("qxzjvw0#%&") for _ in range(150))
    rows = [(k, good(), "s") for k in range(1200)] + [(k, noise(), "s") for k in range(1200, 1260)]
    labels = spark.createDataFrame([(k, 1) for k in range(0, 1200, 2)] + [(1200, 0)], "doc_id LONG, quality INT")
    got = {r["doc_id"]: r["kept"] for r in quality.quality_filter(frame(spark, rows), labels).collect()}
    assert np.mean([got[k] for k in range(1, 1200, 2)]) >= 0.95
    assert not any(got[k] for k in range(1200, 1260))


def test_packs_stay_where_they_are(spark):
    """Grouping a table written in buckets moves none of its rows, and its table goes with it."""
    rows = common.frozen(spark.range(100).withColumnRenamed("id", "batch"), "in-buckets", by="batch")
    other = common.frozen(spark.range(50).withColumnRenamed("id", "batch"), "other")
    both = rows.groupBy("batch").cogroup(other.groupBy("batch")).applyInPandas(lambda a, b: a.assign(n=len(b)), "batch long, n long")
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert both.filter("n = 1").count() == 50 and both.count() == 100
    common.discard(rows)
    assert not spark.catalog.tableExists(rows.written_as)


def test_model_order(spark):
    """The registered model reads four characters before each one: a fifth n-gram length tells texts apart that four do not."""
    rows = [(k, "abcdx" * 3 if k % 2 else "ebcdy" * 3, "s") for k in range(20)] + [(20, "abcdx" * 3, "s"), (21, "abcdy" * 3, "s")]
    labels = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id LONG, quality INT")
    got = {r["doc_id"]: r["perplexity"] for r in quality.quality_filter(frame(spark, rows), labels).collect()}
    learnt = {r["b"] for r in quality.trusted_documents(labels)[0].collect()}
    p = plain_kneser_ney([quality.normal(t) for i, t, _ in rows if i in learnt], 5)
    for i, t, _ in rows[20:]:
        padded = "\x02" * 4 + t + "\x03"
        logs = [np.log(p(padded[k - 4 : k + 1])) for k in range(4, len(padded))]
        assert got[i] == pytest.approx(np.exp(-np.mean(logs)), rel=1e-5)
