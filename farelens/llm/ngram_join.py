"""Similarity join on word shingles: rare-first prefixes with length, positional and suffix filters, each pair verified once.

Two sets with a Jaccard similarity of t or more share a shingle among the first n - ceil(t n) + 1 of each, in any order common to all.
The order here is rare first: shingles by their count in a sketch of the whole corpus (a counter for each hash class), then by hash.
The sketch has a fixed size and only steers the order, so every size of input gives the same links.

Documents with the same set are one class. A prefix shingle of up to FEW classes has all its pairs compared at once and is done: they are
at most PIVOTS / 2 for each posting. For the others candidates come in rounds. In a round every prefix shingle names PIVOTS classes for
each band of set sizes, and the classes that are not yet known to be connected to one are compared with it; the links found
are contracted to components. The first round takes those with the fewest rarer shingles before it: what the members of a group have of
their own is rare, so these lie in its middle and link with most of what can link. Later rounds draw by hash. A large component is drawn in
proportion to its size, so what belongs to it finds a link soon, also where only some of its members link with each other. Prefix shingles whose classes are all connected need no further pair, and later rounds do not read them. What is left, pairs of a shingle
that lie in different components, is compared in full, as soon as these pairs are no more than FULL times the postings, or a round did not
halve them. So a large group of near copies costs comparisons in proportion to its size, and no link that could connect two
components is left out.
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import BATCH_BYTES, discard, frozen, id_or_last, id_or_null, partitions
from farelens.llm.components import components, sized

#: Counters of the sketch, one byte each (counts stop at 255: more frequent ones order by hash), and of one slice of it.
SKETCH_BITS, SLICE_BITS = 24, 18
#: Pairs left, by postings, that are compared in full; above, further rounds come first while each halves them at least.
FULL = 4
#: Pivots of a prefix shingle and band in a round, at most.
PIVOTS = 4
#: Classes of a prefix shingle up to which all its pairs are compared before the rounds.
FEW = PIVOTS + 1
#: Documents up to which their keys, 24 bytes each, are sent to the texts; above, the texts are shuffled.
MAX_BROADCAST = 500_000
#: Words whose hashes are kept in the memory of every Python worker.
MAX_WORDS = 100_000
#: Parts of the hash range whose sizes the suffix filter compares.
PARTS = 16
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


class _WordHashes(dict):
    """Hash of a word, kept for words already seen."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, width: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, no words are an empty set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = (mixed ^ h[k : k + n]) * _MULTIPLIERS[k % 4]
        mixed ^= mixed >> np.uint64(29)
    mixed *= _MULTIPLIERS[1]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def node_of(shingles: np.ndarray) -> int:
    """Name of a set: documents with the same set are one class."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def prefix_length(n: int, threshold: int) -> int:
    """Shingles of a set of n that must meet another set's: n - ceil(t n) + 1, the threshold t in hundredths."""
    return n - -(-threshold * n // 100) + 1


def _sets_and_sketch(docs: DataFrame, width: int) -> DataFrame:
    """Rows of two kinds. Documents: b, sig, n, node (hash of the set), sizes of its parts. Sketch: slice number and a task's counters."""

    def run(batches):
        hashes = _WordHashes()
        sketch = np.zeros(1 << SKETCH_BITS, np.uint8)
        mask = np.uint64(len(sketch) - 1)
        for pdf in batches:
            every = []
            n, node, parts = [], [], []
            for text in pdf["text"]:
                found = shingle_set(text, width, hashes)
                n.append(len(found))
                node.append(node_of(found))
                parts.append(np.bincount(found >> np.uint64(60), minlength=PARTS).astype("<i4").tobytes())
                every.append(found & mask)
            if every:
                place, more = np.unique(np.concatenate(every).astype(np.int64), return_counts=True)
                sketch[place] = np.minimum(sketch[place] + more, 255)
            yield pd.DataFrame(
                {"b": pdf["b"], "sig": pdf["sig"], "n": n, "node": node, "parts": parts, "slice": -1, "counters": None}
            )
        size = 1 << SLICE_BITS
        for k in range(len(sketch) // size):
            own = sketch[k * size : (k + 1) * size]
            if own.any():
                yield pd.DataFrame(
                    {"b": [0], "sig": [0], "n": [0], "node": [0], "parts": [None], "slice": [k], "counters": [zlib.compress(own.tobytes(), 1)]}
                )

    schema = "b long, sig long, n int, node long, parts binary, slice int, counters binary"
    return docs.mapInPandas(run, schema)


def _summed_sketch(rows: DataFrame) -> np.ndarray:
    """Sum of all tasks' counters; its size is fixed, one byte for each of 2 ** SKETCH_BITS."""

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, counters in zip(pdf["slice"], pdf["counters"], strict=True):
                own = np.frombuffer(zlib.decompress(counters), np.uint8).astype(np.int64)
                totals[k] = totals[k] + own if k in totals else own
        for k, total in totals.items():
            yield pd.DataFrame({"slice": [k], "counters": [np.minimum(total, 255).astype(np.uint8).tobytes()]})

    slices = 1 << (SKETCH_BITS - SLICE_BITS)
    summed = rows.select("slice", "counters").repartition(slices, "slice").mapInPandas(add, "slice int, counters binary")
    sketch = np.zeros(1 << SKETCH_BITS, np.uint8)
    for row in summed.collect():
        sketch[row["slice"] << SLICE_BITS : (row["slice"] + 1) << SLICE_BITS] = np.frombuffer(row["counters"], np.uint8)
    return sketch


def _postings(keyed: DataFrame, sketch: Broadcast, width: int, threshold: int) -> DataFrame:
    """Prefix shingles: g, node, n, pos. Of copies that a task meets one posts; some copies of other tasks may remain."""

    def run(batches):
        hashes, counts, seen = _WordHashes(), sketch.value, set()
        mask = np.uint64((1 << SKETCH_BITS) - 1)
        for pdf in batches:
            own, ids, sizes, places = [], [], [], []
            for text in pdf["text"]:
                found = shingle_set(text, width, hashes)
                n, node = len(found), node_of(found)
                if not n or node in seen:
                    continue
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(node)
                keep = prefix_length(n, threshold)
                order = np.lexsort((found, counts[(found & mask).astype(np.int64)]))[:keep]
                own.append(found[order].view(np.int64))
                ids.append(np.full(keep, node))
                sizes.append(np.full(keep, n, np.int32))
                places.append(np.arange(keep, dtype=np.int32))
                if len(own) == 2000:
                    yield frame(own, ids, sizes, places)
                    own, ids, sizes, places = [], [], [], []
            if own:
                yield frame(own, ids, sizes, places)

    def frame(*columns):
        return pd.DataFrame({k: np.concatenate(v) for k, v in zip(("g", "node", "n", "pos"), columns, strict=True)})

    return keyed.select("text").mapInPandas(run, "g long, node long, n int, pos int")


def _few_pairs(g: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (u, v) of classes that share a shingle and pass the filters of ``_passes``; rows by g and node, at most FEW of a shingle."""
    us, vs = [], []
    left = n - pos
    for d in range(1, FEW):
        i = np.flatnonzero(g[d:] == g[:-d])
        j = i + d
        length = 100 * np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])
        needed = np.ceil((n[i] + n[j]) * threshold / (100.0 + threshold) - 1e-9)
        kept = length & (np.minimum(left[i], left[j]) >= needed)
        us.append(node[i[kept]])
        vs.append(node[j[kept]])
    return np.concatenate(us), np.concatenate(vs)


def _shared(postings: DataFrame, threshold: int) -> DataFrame:
    """Postings of shingles that more than FEW classes have in their prefixes, each once; of the others the pairs of classes.

    A row with n = 0 is the pair (g, node), once for each shingle; one with n = -1 says how many postings (g) were turned into pairs.
    A shingle that one class has finds nothing. One shuffle, row after row.
    """

    def run(batches):
        # The last shingle's rows as long as they are few; beyond, its last row, which has left already (``many``).
        held, many = None, False
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf])
            g, node = pdf["g"].to_numpy(), pdf["node"].to_numpy()
            fresh = np.append(True, (g[1:] != g[:-1]) | (node[1:] != node[:-1]))
            pdf, g = pdf[fresh], g[fresh]
            starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            sizes = np.diff(np.append(starts, len(g)))
            large = sizes > FEW
            large[0] |= many
            keep = np.repeat(large, sizes)
            few = ~keep
            keep[0] &= not many
            many = bool(large[-1])
            few[starts[-1] :] = False
            held = pdf.iloc[-1:] if many else pdf.iloc[starts[-1] :]
            yield pdf[keep]
            yield from settled(pdf[few])
        if held is not None and not many:
            yield from settled(held)

    def settled(pdf):
        g, node, n, pos = (pdf[c].to_numpy().astype(np.int64) for c in ("g", "node", "n", "pos"))
        same = g[1:] == g[:-1]
        u, v = _few_pairs(g, node, n, pos, threshold)
        yield pd.DataFrame({"g": u, "node": v, "n": 0, "pos": 0})
        met = (np.append(False, same) | np.append(same, False)).sum() if len(g) else 0
        yield pd.DataFrame({"g": [met], "node": 0, "n": -1, "pos": 0})

    dealt = postings.repartition(partitions(postings.sparkSession), "g").sortWithinPartitions("g", "node")
    return dealt.mapInPandas(run, "g long, node long, n int, pos int")


def _needed(total: Column, threshold: int) -> Column:
    """Shingles that two sets of ``total`` together must share."""
    return F.ceil(total * threshold / (100.0 + threshold) - 1e-9)


def _passes(threshold: int) -> Column:
    """Length and positional filter for columns n, pos and pn, ppos.

    All shingles that two sets share come after the first of them, in both. So a pair that can link meets at a shingle with as many places
    from there on, in both sets, as the two must share: its first one. Other meetings of the pair need not be looked at.
    """
    n, pn, pos, ppos = F.col("n"), F.col("pn"), F.col("pos"), F.col("ppos")
    length = (100 * F.least(n, pn)) >= (threshold * F.greatest(n, pn))
    return length & (F.least(n - pos, pn - ppos) >= _needed(n + pn, threshold))


def _suffix_filtered(pairs: DataFrame, info: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose sets can agree enough: what the parts of the hash range differ by in size is missing from the overlap."""
    rows = pairs.join(info.toDF("u", "nu", "pu"), "u").join(info.toDF("v", "nv", "pv"), "v")

    @F.pandas_udf("long")
    def differ(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), "<i4").reshape(-1, PARTS).astype(np.int64) for s in (a, b))
        return pd.Series(np.abs(x - y).sum(1))

    total = F.col("nu") + F.col("nv")
    return rows.filter(differ("pu", "pv") <= total - 2 * _needed(total, threshold)).select("u", "v")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """Links among the pairs (u, v): 100 * shared >= threshold * all. Sets are made once for each class in a pair."""

    def sets(batches):
        hashes = _WordHashes()
        for pdf in batches:
            made = [shingle_set(text, width, hashes).tobytes() for text in pdf["text"]]
            yield pd.DataFrame({"node": pdf["node"], "shingles": made})

    ids = frozen(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "in-pairs")
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids
    found = texts.join(ids, "node", "left_semi").mapInPandas(sets, "node long, shingles binary")

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * shared >= threshold * (len(x) + len(y) - shared))
        return pd.Series(out, dtype=bool)

    both = pairs.join(found.toDF("u", "su"), "u").join(found.toDF("v", "sv"), "v")
    return both.filter(linked("su", "sv")).select("u", "v")


def _star_pairs(posted: DataFrame, threshold: int, turn: int) -> DataFrame:
    """Candidates of a round: for each prefix shingle and band of sizes, the pivots with the classes of other components."""
    band = F.floor(F.log(F.col("n")) / math.log(100 / threshold)).alias("band") if threshold < 100 else F.col("n").alias("band")
    banded = posted.select("*", band)
    drawn = F.xxhash64("node", F.lit(turn))
    # The first class of each draw: a plain minimum, summed up before the shuffle however many classes a shingle has.
    ahead = F.lit(0) if turn else F.col("pos")
    first = F.min(F.struct(ahead.alias("ahead"), drawn.alias("h"), "node", "n", "pos", "comp")).alias("p")
    pivots = banded.groupBy("g", "band", F.pmod(drawn, F.lit(PIVOTS)).alias("draw")).agg(first).select(
        "g", "band", F.col("p.node").alias("pnode"), F.col("p.n").alias("pn"), F.col("p.pos").alias("ppos"), F.col("p.comp").alias("pcomp")
    )
    return _pairs(banded.join(pivots, ["g", "band"]).filter("comp <> pcomp"), threshold)


def _pairs(rows: DataFrame, threshold: int) -> DataFrame:
    kept = rows.filter(_passes(threshold))
    return kept.select(F.least("node", "pnode").alias("u"), F.greatest("node", "pnode").alias("v")).distinct()


def _outside(posted: DataFrame) -> DataFrame:
    """For each prefix shingle with several components: g, its largest component, members, members outside of that component."""
    parts = posted.groupBy("g", "comp").agg(F.count("*").alias("k"))
    whole = parts.groupBy("g").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("members"))
    split = whole.filter("members > top.k")
    return split.select("g", F.col("top.comp").alias("main"), "members", (F.col("members") - F.col("top.k")).alias("outside"))


def _rest_pairs(rows: DataFrame, threshold: int) -> DataFrame:
    """All pairs of a prefix shingle that lie in different components, each once; ``main`` is its largest component."""
    others = rows.filter("comp <> main").drop("main")
    partners = rows.select("g", "main", *[F.col(c).alias(f"p{c}") for c in ("node", "n", "pos", "comp")])
    met = others.join(partners, "g").filter("comp <> pcomp and (pcomp = main or node < pnode)")
    return _pairs(met, threshold)


def _posted(met: DataFrame) -> DataFrame:
    return met.filter("n > 0")


def _few(met: DataFrame) -> DataFrame:
    return met.filter("n = 0").select(F.col("g").alias("u"), F.col("node").alias("v"))


def _links(met: DataFrame, info: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame | None:
    """(node, component) of linked classes; None where there are none."""
    tested, links, labels, work_before = None, None, None, math.inf
    posted, few = _posted(met), _few(met)
    n = met.agg(F.sum(F.when(F.col("n") > 0, 1).when(F.col("n") < 0, F.col("g")))).first()[0] or 0
    for turn in itertools.count():
        named = posted.select("g", "node", "n", "pos")
        if labels is None:
            current = named.withColumn("comp", F.col("node"))
        else:
            current = named.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        last = False
        if turn:
            current = frozen(current, "labelled")
            outside = frozen(_outside(current), "outside")
            work = outside.agg(F.sum(F.col("outside") * F.col("members"))).first()[0] or 0
            if not work:
                break
            # Where a round connected little, what is left is mostly unlike: another pivot would not spare its comparison.
            last = work <= FULL * n or 2 * work > work_before
            work_before = work
            # A shingle whose classes are connected stays so: from here on its postings are not read.
            posted = frozen(current.join(outside.select("g", "main"), "g"), "split")
            for table in (current, outside):
                discard(table)
            current = posted
        pairs = _rest_pairs(current, threshold) if last else _star_pairs(current, threshold, turn)
        pairs = pairs.join(tested, ["u", "v"], "left_anti") if turn else pairs.unionByName(few).distinct()
        pairs = sized(frozen(pairs, "pairs"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        candidates = frozen(_suffix_filtered(pairs, info, threshold), "candidates")
        found = frozen(_verified(sized(candidates), texts, width, threshold), "links", batch=BATCH_BYTES)
        discard(candidates)
        found = sized(found)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = components(links)
        if last:
            break
    return labels


def ngram_rows(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """b (doc_id, null last), sig (hash of the text), n_shingles, and ``least``: the smallest (b, sig) reachable by links, of every row.

    A set holds the distinct shingles of ``width`` words, A-Z lower-cased; a text with fewer words is one shingle; a null text or one
    without words has no set and links with nothing. Documents link at a Jaccard similarity of ``threshold`` hundredths or more.
    Every row is a document of its own, also where a doc_id repeats; a null doc_id comes after all others. Texts of any length are one
    row each. Only doc_id and text are read. An empty table gives an empty result.
    """
    keyed = docs.select(id_or_last(F.col("doc_id")).alias("b"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("sig"), "text")
    made = frozen(_sets_and_sketch(keyed, width), "sets", batch=BATCH_BYTES)
    rows = made.filter("slice < 0").drop("slice", "counters")
    sketch = docs.sparkSession.sparkContext.broadcast(_summed_sketch(made.filter("slice >= 0")))
    # One class for each set; its smallest (b, sig) stands for it.
    firsts = (F.min(F.struct("b", "sig")).alias("rep"), F.first("n").alias("n"), F.first("parts").alias("parts"))
    classes = rows.filter("n > 0").groupBy("node").agg(*firsts)
    classes = frozen(classes.select("node", "rep.b", "rep.sig", "n", "parts"), "classes")
    met = frozen(_shared(_postings(keyed, sketch, width, threshold), threshold), "postings", batch=BATCH_BYTES)
    sketch.destroy()
    nodes = _posted(met).select("node").union(_few(met).select("u")).union(_few(met).select("v")).distinct()
    candidates = frozen(nodes.join(classes.select("node", "b", "sig"), "node"), "candidates")
    n = candidates.count()
    # Their texts, one for each class: rows that repeat (b, sig) are equal.
    found = keyed.join(F.broadcast(candidates) if n <= MAX_BROADCAST else candidates, ["b", "sig"]).select("node", "text")
    held = frozen(found, "candidate-texts")
    if held.count() > n:
        held = frozen(held.dropDuplicates(["node"]), "candidate-texts")
    labels = _links(met, classes.select("node", "n", "parts"), held, width, threshold)
    # A component may hold any share of the rows: names go to its classes first, then from classes to rows.
    linked = classes.withColumn("component", F.lit(None).cast("long")) if labels is None else classes.join(labels, "node", "left")
    own = F.struct("b", "sig")
    of_class = linked.select("node", own.alias("rep"), F.coalesce("component", "node").alias("component"))
    smallest = of_class.groupBy("component").agg(F.min("rep").alias("least"))
    named = of_class.join(smallest, "component").select("node", "least")
    with_set = rows.filter("n > 0").join(named, "node").select("b", "sig", F.col("n").cast("long").alias("n_shingles"), "least")
    without = rows.filter("n = 0").select("b", "sig", F.lit(0).cast("long").alias("n_shingles"), own.alias("least"))
    return with_set.unionByName(without)


def ngram_components(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row of ``docs``; see ``ngram_rows``."""
    return ngram_rows(docs, width, threshold).select(
        id_or_null(F.col("b")).alias("doc_id"), "n_shingles", id_or_null(F.col("least.b")).alias("component_id")
    )
