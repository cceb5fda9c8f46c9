"""MinHash fingerprints of whole texts, their likeness, and near duplicates by signature bands.

A fingerprint keeps, for each of many random permutations x -> a x + b (modulo 2^32, a odd) of the shingles' hashes, the smallest
value over the text's shingles. Two texts agree at a place with the probability of their shingle sets' Jaccard similarity, so
the share of equal places estimates it. Near duplicates are looked for by bands of places: texts that agree in a whole band
are compared by their sets, and linked at a similarity of the threshold or more.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import frozen, id_or_last, id_or_null, partitions, whole_text
from farelens.llm.components import components

#: Places of a fingerprint, words of a shingle, places of a band.
PLACES, WIDTH, BAND = 128, 5, 4
#: Shingles that are permuted at once: the table of a step stays in the processor's cache.
STEP = 2048
#: Pairs left, by rows of all bands, that are compared without further rounds.
FULL = 4
#: Ranges of ids for each partition when documents are put in order.
RANGES = 4
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class _WordHashes(dict):
    """Hashes of words already seen, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Fingerprinter:
    """Permutations drawn from a seed."""

    def __init__(self, places: int = PLACES, width: int = WIDTH, seed: int = 1):
        drawn = np.random.default_rng(seed).integers(0, 1 << 32, (2, places, 1), np.uint32)
        self.times, self.plus, self.width = drawn[0] | np.uint32(1), drawn[1], width
        self.words = _WordHashes()

    def shingles(self, text: str) -> np.ndarray:
        """Hashes of all runs of ``width`` words, A-Z lower-cased, repeated ones too; fewer words are one run, no words none."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if len(words) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)
        hashes = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = len(words) - self.width + 1
        out = np.zeros(n, np.uint64)
        for k in range(self.width):
            out = (out ^ hashes[k : k + n]) * _MIX[k % 3]
            out ^= out >> np.uint64(29)
        return out * _MIX[1]

    def signature(self, text: str) -> np.ndarray:
        """Smallest permuted hash at every place; the largest number everywhere for a text without words."""
        hashes = (self.shingles(text) >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.times), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(hashes), STEP):
            table = self.times * hashes[at : at + STEP]
            table += self.plus
            np.minimum(least, table.min(1), out=least)
        return least


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal places."""
    return float((a == b).mean())


def text_of(signature: np.ndarray) -> str:
    """Eight hex digits for each place."""
    return signature.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, places: int = PLACES, width: int = WIDTH, seed: int = 1) -> DataFrame:
    """doc_id and fingerprint (four bytes, little-endian, for each place) of every row of ``docs``; a null text is empty.

    Texts are read whole. A text without words agrees with other such texts only. Other columns are not read.
    """

    def run(batches):
        made = Fingerprinter(places, width, seed)
        for pdf in batches:
            signatures = [made.signature(text).astype("<u4").tobytes() for text in pdf["text"]]
            yield pd.DataFrame({"b": pdf["b"], "fingerprint": signatures})

    rows = docs.select(id_or_last(F.col("doc_id")).alias("b"), whole_text().alias("text"))
    return rows.mapInPandas(run, "b long, fingerprint binary").select(id_or_null(F.col("b")).alias("doc_id"), "fingerprint")


class _Ranges:
    """Ranges of (b, sig) in ascending order: bounds between them, and the first key of each one that has rows."""

    def __init__(self, bounds: list[tuple[int, int]]):
        self.b = np.array([x[0] for x in bounds], np.int64)
        self.sig = np.array([x[1] for x in bounds], np.int64)

    def of(self, b: np.ndarray, sig: np.ndarray) -> np.ndarray:
        """Number of bounds at or below each key."""
        low, out = np.searchsorted(self.b, b, "left"), np.searchsorted(self.b, b, "right")
        for value in np.unique(b[low < out]):
            same = b == value
            start, end = low[same][0], out[same][0]
            out[same] = start + np.searchsorted(self.sig[start:end], sig[same], "right")
        return out.astype(np.int64)


def _ranges(keys: DataFrame) -> tuple[_Ranges, dict[tuple[int, int], int]]:
    """Ranges of about equal numbers of keys, and for the first key of each range with rows the range before it (the last, before the first).

    The driver sees a sample of the distinct keys and one key for each range, both in proportion to the number of ranges.
    """
    spark = keys.sparkSession
    count = RANGES * partitions(spark)
    every = max(1, keys.count() // (50 * count))
    sample = keys.filter(F.pmod(F.xxhash64("b", "sig"), F.lit(every)) == 0).collect()
    taken = sorted((row["b"], row["sig"]) for row in sample)
    ranges = _Ranges([taken[len(taken) * k // count] for k in range(1, count)] if len(taken) >= count else taken)

    def first_keys(batches):
        for pdf in batches:
            pdf["range"] = ranges.of(pdf["b"].to_numpy(), pdf["sig"].to_numpy())
            yield pdf.sort_values(["b", "sig"]).drop_duplicates("range")

    found = keys.mapInPandas(first_keys, "b long, sig long, range long").groupBy("range").agg(F.min(F.struct("b", "sig")).alias("key"))
    firsts = sorted((row["range"], (row["key"]["b"], row["key"]["sig"])) for row in found.collect())
    return ranges, {key: firsts[k - 1][0] for k, (_, key) in enumerate(firsts)}


def edited_text(text: str, following: str) -> str:
    """The text whose last half, rounded down, is replaced by as many code points of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_fingerprints(docs: DataFrame, places: int = PLACES, width: int = WIDTH, seed: int = 1) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row of ``docs``.

    The edited text is that of ``edited_text`` with the next row by doc_id, null last, then by hash of the text; the first row follows the
    last, and a single row follows itself. Fingerprints are hex text; likenesses are shares of equal places. A null text is
    empty. Rows that repeat a doc_id and its text follow one another. Other columns are not read. An empty table gives an empty result.

    Texts are shuffled once, into ranges of ids. The first row of a range is sent to the range before it as well, so that every range
    is worked on alone, row after row. Equal rows of a batch travel as one.
    """
    rows = docs.select(id_or_last(F.col("doc_id")).alias("b"), F.xxhash64(whole_text()).alias("sig"), whole_text().alias("text"))
    ranges, before = _ranges(frozen(rows.select("b", "sig").distinct(), "keys"))
    firsts = pd.MultiIndex.from_tuples(list(before), names=["b", "sig"]) if before else None

    def dealt(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = pd.DataFrame({"b": batch.column(0).to_numpy(), "sig": batch.column(1).to_numpy()})
            times = keys.groupby(["b", "sig"], sort=False)["b"].transform("size").to_numpy()
            once = np.flatnonzero(~keys.duplicated().to_numpy())
            keys = keys.iloc[once]
            place = ranges.of(keys["b"].to_numpy(), keys["sig"].to_numpy())
            ahead = np.flatnonzero(pd.MultiIndex.from_frame(keys).isin(firsts))
            back = np.array([before[b, sig] for b, sig in keys.iloc[ahead].itertuples(index=False, name=None)], np.int64)
            taken = batch.take(pa.array(np.concatenate([once, once[ahead]])))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([place, back])),
                    pa.array(np.repeat([False, True], [len(once), len(ahead)])),
                    taken.column(0),
                    taken.column(1),
                    pa.array(np.concatenate([times[once], times[once[ahead]]]).astype(np.int64)),
                    taken.column(2),
                ],
                ["range", "ahead", "b", "sig", "times", "text"],
            )

    order = ["range", "ahead", "b", "sig"]
    moved = rows.mapInArrow(dealt, "range long, ahead boolean, b long, sig long, times long, text string")
    moved = moved.repartition(partitions(docs.sparkSession), "range").sortWithinPartitions(*order)

    def compared(batches):
        made = Fingerprinter(places, width, seed)

        def row(doc, text, signature, following, own, copies):
            edited = edited_text(text, following)
            changed = made.signature(edited)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            near = likeness(signature, changed), likeness(signature, own)
            return doc, len(text), digest, text_of(signature), text_of(changed), *near, copies

        held = None
        for pdf in batches:
            out = []
            for place, ahead, b, sig, times, text in pdf.itertuples(index=False, name=None):
                if held is not None and held[0] == place and not ahead and (held[1], held[4]) == (b, text):
                    held[3] += times
                    continue
                signature = None if held is None and ahead else made.signature(text)
                if held is not None and held[0] == place:
                    _, doc, own, n, whole = held
                    if n > 1:
                        out.append(row(doc, whole, own, whole, own, n - 1))
                    out.append(row(doc, whole, own, text, signature, 1))
                held = None if ahead else [place, b, signature, times, text]
            yield pd.DataFrame(out, columns=names)

    schema = (
        "b long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
        "copies long"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    found = moved.mapInPandas(compared, schema).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.select(id_or_null(F.col("b")).alias("doc_id"), *names[1:-1])


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_documents(docs: DataFrame, threshold: float = 0.8, places: int = PLACES, width: int = WIDTH, band: int = BAND, seed: int = 1) -> DataFrame:
    """doc_id and near_id, the smallest doc_id reachable by links, of every row of ``docs``.

    Documents that agree in all places of a band meet the band's least document, and link when the Jaccard similarity of their shingle sets is
    ``threshold`` or more; then the others of the band that are not connected meet their next least, until the pairs left are few enough
    to be compared all. Documents with the same set are one. At a similarity of s, two documents share a band with probability 1 - (1 - s^band)^(places / band): above 0.9999999 at 0.8 as
    set here. Texts without words link with nothing. A null doc_id comes last. Other columns are not read.
    """
    keyed = docs.select(id_or_last(F.col("doc_id")).alias("b"), F.xxhash64(whole_text()).alias("sig"), whole_text().alias("text"))
    starts = range(0, places, band)

    def signed(batches):
        made = Fingerprinter(places, width, seed)
        for pdf in batches:
            rows = []
            for b, sig, text in pdf.itertuples(index=False, name=None):
                shingles = np.unique(made.shingles(text))
                if len(shingles):
                    signature = made.signature(text)
                    keys = [xxhash.xxh3_64_intdigest(signature[k : k + band].tobytes(), seed=k) - (1 << 63) for k in starts]
                    rows.append((b, sig, xxhash.xxh3_128_digest(shingles.tobytes()), keys))
            yield pd.DataFrame(rows, columns=["b", "sig", "set", "keys"])

    made = frozen(keyed.mapInPandas(signed, "b long, sig long, set binary, keys array<long>"), "signatures")
    # One document for each set; the others share what it finds.
    classes = made.groupBy("set").agg(F.min(F.struct("b", "sig")).alias("rep"), F.first("keys").alias("keys"))
    classes = frozen(classes.select(F.col("set").alias("node"), "rep.b", "rep.sig", "keys"), "classes")
    posted = classes.select("node", F.explode("keys").alias("key"))
    met = posted.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key")
    posted = frozen(posted.join(met, "key"), "bands")
    candidates = posted.select("node").distinct().join(classes.select("node", "b", "sig"), "node")
    texts = keyed.dropDuplicates(["b", "sig"]).join(candidates, ["b", "sig"]).select("node", "text")

    def sets(batches):
        hasher = Fingerprinter(1, width, seed)
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["node"], "shingles": [np.unique(hasher.shingles(t)).tobytes() for t in pdf["text"]]})

    held = frozen(texts.mapInPandas(sets, "node binary, shingles binary"), "sets")

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            out.append(shared >= threshold * (len(x) + len(y) - shared) - 1e-9)
        return pd.Series(out, dtype=bool)

    links, tested, labels, last = None, None, None, False
    postings = posted.count()
    left = posted.withColumn("component", F.col("node"))
    while not last:
        work = left.groupBy("key").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0] or 0
        if not work:
            break
        last = work <= FULL * postings
        if last:
            others = left.select("key", F.col("node").alias("other"), F.col("component").alias("at"))
            met = left.join(others, "key").filter("node < other and component <> at").select(F.col("node").alias("u"), F.col("other").alias("v"))
        else:
            pivot = F.min(F.struct(F.xxhash64("node", "key").alias("h"), "node", "component")).alias("p")
            pivots = left.groupBy("key").agg(pivot).select("key", F.col("p.node").alias("pivot"), F.col("p.component").alias("at"))
            pivots = frozen(pivots, "pivots")
            met = left.join(pivots, "key").filter("component <> at")
            met = met.select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v"))
        pairs = met.distinct()
        pairs = frozen(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
        tested = pairs if tested is None else frozen(tested.unionByName(pairs), "tested")
        both = pairs.join(held.toDF("u", "su"), "u").join(held.toDF("v", "sv"), "v")
        found = frozen(both.filter(similar("su", "sv")).select("u", "v"), "links")
        if not found.isEmpty():
            links = found if links is None else frozen(links.unionByName(found), "all-links")
            labels = components(links)
        if not last:
            # A pivot has met all members of its band that it is not connected to: the others go on without it.
            rest = left.join(pivots.select("key", F.col("pivot").alias("node")), ["key", "node"], "left_anti").drop("component")
            rest = rest.withColumn("component", F.col("node")) if labels is None else _labelled(rest, labels)
            open_keys = rest.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("z")).filter("a < z").select("key")
            left = frozen(rest.join(open_keys, "key"), "left")
    own = F.struct("b", "sig")
    linked = classes.select("node", own.alias("rep"))
    linked = linked.withColumn("component", F.col("node")) if labels is None else _labelled(linked, labels)
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    named = made.select("b", "sig", F.col("set").alias("node")).join(linked.join(least, "component").select("node", "least"), "node")
    wordless = keyed.select("b", "sig").distinct().join(made.select("b", "sig"), ["b", "sig"], "left_anti")
    every = named.select("b", F.col("least.b").alias("near")).unionByName(
        keyed.select("b", "sig").join(wordless, ["b", "sig"], "left_semi").select("b", F.col("b").alias("near"))
    )
    return every.select(id_or_null(F.col("b")).alias("doc_id"), id_or_null(F.col("near")).alias("near_id"))
