"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration.

Labelled documents of a bounded sample fall into three parts by a hash. The first gives a lexicon of words and word stems that stand
out in toxic texts, the second trains the trees, the third fits the calibration. Only the text is an input of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelens.llm.common import BATCH_BYTES, frozen, id_or_last, id_or_null, small_batches

#: Bound of the labelled sample, and of the lexicon.
TRAIN_ROWS, LEXICON_ENTRIES = 20_000, 5_000
#: Words whose log odds are kept in the memory of every Python worker.
MAX_WORDS = 100_000
#: A lexicon entry is in this many toxic texts at least; log odds from which on it counts as mild and as strong.
LEAST_TOXIC, MILD, STRONG = 3, 2.5, 4.5
THRESHOLD = 0.3
STEMS = (4, 5)
#: Plain insults, known without any labels.
INSULTS = frozenset(
    """idiot idiots moron morons stupid dumb loser losers trash garbage scum pathetic worthless disgusting clown clowns jerk fool
    fools imbecile cretin bastard bitch asshole shit fuck fucking crap damn hate hateful ugly filthy vermin pig pigs liar coward
    dummkopf arschloch scheisse idioot connard salaud merde imbécile idiota estúpido estúpida pendejo cabrón mierda tonto""".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".split()
)
NEAR = 3
FEATURES = (
    "log_words", "insults", "mild", "strong", "log_strong", "weight", "second", "second_near", "capitals", "loud_words", "bangs",
    "questions", "marks", "mixed_words", "repeats", "veiled",
)
_WORD = re.compile(r"\w+")
_MIXED = re.compile(r"[^\W\d_]+[0-9@$*#!|+]+[^\W\d_]+")
_REPEAT = re.compile(r"([^\W\d_])\1\1")
_UPPER = re.compile(r"[A-Z]")
_VEIL = str.maketrans("0134578@$!|+*#", "oieastbasilt  ")


def entries(word: str) -> list[str]:
    """What a word may be known by: itself and its stems."""
    return [word, *(word[:k] + "~" for k in STEMS if len(word) > k)]


class _Weights(dict):
    """Log odds of a word: the largest of its entries in the lexicon, 0 without one."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) >= MAX_WORDS:
            self.clear()
        value = self[word] = max((self.lexicon.get(e, 0.0) for e in entries(word)), default=0.0)
        return value


def features(text: str, weights: _Weights) -> list[float]:
    """Dense features of one text, in the order of FEATURES; an empty text is all zero."""
    original = _WORD.findall(text)
    words = list(map(str.lower, original))
    n, points = max(1, len(words)), max(1, len(text))
    w = np.fromiter(map(weights.__getitem__, words), float, len(words))
    known = np.fromiter(map(INSULTS.__contains__, words), bool, len(words))
    you = np.flatnonzero(np.fromiter(map(SECOND_PERSON.__contains__, words), bool, len(words)))
    strong = w >= STRONG
    hits = np.flatnonzero(strong | known)
    near = 0
    if len(you) and len(hits):
        place = np.searchsorted(you, hits)
        left, right = you[np.maximum(place - 1, 0)], you[np.minimum(place, len(you) - 1)]
        near = int((np.minimum(np.abs(hits - left), np.abs(hits - right)) <= NEAR).sum())
    mixed = _MIXED.findall(text)
    veiled = sum(v in INSULTS or weights[v] >= STRONG for v in (m.lower().translate(_VEIL).replace(" ", "") for m in mixed))
    loud = sum(map(str.isupper, original))
    bangs, questions = text.count("!"), text.count("?")
    marks = sum(map(text.count, "*$%&#@^~"))
    return [
        math.log1p(len(words)), known.sum() / n, ((w >= MILD) & ~strong).sum() / n, strong.sum() / n, math.log1p(strong.sum()),
        w.sum() / n, len(you) / n, near / n, len(_UPPER.findall(text)) / points, loud / n, bangs / points, questions / points,
        marks / points, len(mixed) / n, sum(1 for _ in _REPEAT.finditer(text)) / n, veiled / n,
    ]


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the doc_id as text, modulo 4, is 2. A null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def _sample(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` labelled rows outside of the held-out part: _id, text, toxic (0.0 or 1.0)."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("double").alias("toxic"))
    n = one.count()
    place = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1_000_000))
    chosen = one.filter(place < (1_000_000 * bound) // max(n, bound))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "_id").select("_id", "text", "toxic")  # bounded: two numbers for each of ``bound`` rows


def _dealt(sample: DataFrame) -> DataFrame:
    """The sample with part (0, 1, 2): two fifths, two fifths and a fifth of the ids of either label, each part some if there are three."""
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("_id", F.lit(12)), "_id")  # bounded, as the sample is
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(5)) + 1
    part = F.element_at(F.array(*map(F.lit, (0, 1, 2, 0, 1))), turn)
    ids = sample.select("_id", "toxic").distinct().select("_id", part.alias("part"))
    return sample.join(F.broadcast(ids), "_id").select("text", "toxic", "part")


def _entry_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of few texts at a time, with the number of toxic (p) and other texts (q) that hold them."""
    for batch in small_batches(batches):
        with_, without = Counter(), Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found = {e for word in set(map(str.lower, _WORD.findall(text))) for e in entries(word)}
            (with_ if toxic else without).update(found)
        every = list(with_.keys() | without.keys())
        p, q = (pa.array([counts[e] for e in every], pa.int64()) for counts in (with_, without))
        yield pa.RecordBatch.from_pydict({"entry": pa.array(every, pa.string()), "p": p, "q": q})


def _feature_batches(batches: Iterator[pa.RecordBatch], lexicon: dict[str, float], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns ``keep`` and ``f``, the features, of few texts at a time."""
    weights = _Weights(lexicon)
    for batch in small_batches(batches):
        found = [features(text or "", weights) for text in batch.column("text").to_pylist()]
        columns = {c: batch.column(c) for c in keep}
        yield pa.RecordBatch.from_pydict(columns | {"f": pa.array(found, pa.list_(pa.float64()))})


def _lexicon(sample: DataFrame, size: int) -> dict[str, float]:
    """Words and stems of toxic texts with their log odds; at most ``size``, the highest."""

    counted = sample.select("text", "toxic").mapInArrow(_entry_batches, "entry string, p long, q long")
    counts = counted.groupBy("entry").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    toxic, clean = (sample.filter(F.col("toxic") == k).count() for k in (1, 0))
    odds = F.log((F.col("p") + 0.5) / (toxic + 1.0)) - F.log((F.col("q") + 0.5) / (clean + 1.0))
    best = counts.filter(F.col("p") >= LEAST_TOXIC).withColumn("odds", odds).filter(F.col("odds") >= MILD)
    return {row["entry"]: row["odds"] for row in best.orderBy(F.desc("odds"), "entry").limit(size).collect()}


def _with_features(df: DataFrame, lexicon: dict[str, float], keep: list[str]) -> DataFrame:
    """Columns ``keep`` and one array of features for each row; the text stays behind."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    made = df.select(*keep, "text").mapInArrow(lambda batches: _feature_batches(batches, shared.value, keep), f"{kinds}, f array<double>")
    return made.select(*keep, *[F.col("f")[k].alias(name) for k, name in enumerate(FEATURES)])


class ToxicityModel:
    """Lexicon, trees and calibration, each from its own part of the sample.

    If the sample has fewer than three labels of a kind, all three learn from all of it. Only where it lacks one kind altogether is the
    score the share of toxic labels (0 without any).
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS):
        sample = frozen(_sample(docs, labels, bound), "labelled")
        rows = {r["toxic"]: r for r in sample.groupBy("toxic").agg(F.count("*").alias("n"), F.countDistinct("_id").alias("ids")).collect()}
        total = sum(r["n"] for r in rows.values())
        self.base = rows[1.0]["n"] / total if 1.0 in rows else 0.0
        self.trees = None
        self.lexicon: dict[str, float] = {}
        if len(rows) < 2:
            return
        if min(r["ids"] for r in rows.values()) < 3:
            words = learned = sample.withColumn("part", F.lit(1))
            calibrate = 1
        else:
            dealt = frozen(_dealt(sample), "dealt")
            words, learned, calibrate = dealt.filter("part = 0"), dealt.filter("part > 0"), 2
        self.lexicon = _lexicon(words, LEXICON_ENTRIES)
        rows = frozen(_with_features(learned, self.lexicon, ["toxic", "part"]).coalesce(4), "features", batch=BATCH_BYTES)
        self.assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
        vectors = self.assembler.transform(rows)
        booster = GBTClassifier(
            featuresCol="vector", labelCol="toxic", maxDepth=3, maxIter=20, stepSize=0.2, minInstancesPerNode=5, seed=7
        )
        self.trees = booster.fit(vectors.filter("part = 1"))
        fitted = self._raw(vectors.filter(F.col("part") == calibrate))
        self.calibration = IsotonicRegression(featuresCol="raw", labelCol="toxic", predictionCol="level").fit(fitted)

    def _raw(self, vectors: DataFrame) -> DataFrame:
        return self.trees.transform(vectors).withColumn("raw", vector_to_array("rawPrediction")[1])

    def score(self, docs: DataFrame) -> DataFrame:
        """b (doc_id, null last), sig (hash of the text) and score of every row.

        The calibrated level is a step function; a hundredth of the score follows the trees' own output and orders what lies on a step.
        """
        text = F.coalesce("text", F.lit(""))
        rows = docs.select(id_or_last(F.col("doc_id")).alias("b"), F.xxhash64(text).alias("sig"), text.alias("text"))
        if self.trees is None:
            return rows.select("b", "sig", F.lit(self.base).alias("score"))
        found = _with_features(rows, self.lexicon, ["b", "sig"])
        scored = self.calibration.transform(self._raw(self.assembler.transform(found)))
        fine = 1 / (1 + F.exp(-2 * F.col("raw")))
        return scored.select("b", "sig", (0.99 * F.col("level") + 0.01 * fine).alias("score"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from THRESHOLD on) of every row of ``docs``.

    ``labels`` gives toxic (0 or 1; others and null are not used) by doc_id, the largest where an id repeats. At most about ``bound`` of
    them are learned from, none whose doc_id is held out. A null text is empty, and gets the score of an empty text; rows that repeat
    are scored each; a null doc_id is scored and never learned from. Other columns are not read.
    """
    scored = ToxicityModel(docs, labels, bound).score(docs)
    doc_id = id_or_null(F.col("b"))
    return scored.select(
        doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
