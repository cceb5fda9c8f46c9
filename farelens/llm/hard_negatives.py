"""Hard negatives by a vertical scan: dimensions are read in each anchor's descending order of magnitude.

The rows of a block lie as columns, one for each dimension. For an anchor the columns with its largest components come first; after every
few of them, the least and the most that the dimensions still to read can add (from the smallest and largest value of each column) bound
every candidate's score. Candidates whose bounds cannot reach an answer leave the candidate bitmap, and when all dimensions are read
the scores of those left are exact. Positives are found first; their scores fix the windows of the negatives.

Anchors meet all rows in cells, a block of rows and a group of anchors each, so no task holds more than one block and one group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelens.llm.common import NULL_ID, frozen, id_or_last, id_or_null

#: Rows of a block, anchors of a group, and dimensions read between two looks at the bounds.
BLOCK, GROUP, STEP = 16_384, 1_024, 8
_ROW = "b long, label long, q binary, times long"


def usable_rows(rows: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """b (vec_id, null last), label, q (floor(scale * x) of each component, as bytes of longs) and times, the number of equal rows.

    Rows without a label or vector, or with a component that is null or not finite, are left out.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    taken = rows.select(id_or_last(F.col("vec_id")).alias("b"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>"))
    taken = taken.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))))
    # Equal rows are one from here on, so that no number of copies makes a block larger.
    counted = taken.select("b", "label", whole.alias("q")).groupBy("b", "label", "q").agg(F.count("*").alias("times"))

    def packed(batches):
        for pdf in batches:
            yield pdf.assign(q=[np.asarray(q, "<i8").tobytes() for q in pdf["q"]])

    return counted.mapInPandas(packed, _ROW)


def _matrix(vectors: Sequence[bytes], dims: int) -> np.ndarray:
    """Vectors as rows; beyond its end a shorter one is zero."""
    if all(len(v) == 8 * dims for v in vectors):
        return np.frombuffer(b"".join(vectors), "<i8").reshape(len(vectors), dims)
    out = np.zeros((len(vectors), dims), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v) // 8] = np.frombuffer(v, "<i8")
    return out


def _exact_kind(rows: np.ndarray, anchors: np.ndarray, scale: int) -> type:
    """Numbers that hold every score times ``scale`` exactly: doubles, longs, or Python's own."""
    largest = [max((abs(int(x)) for x in (m.min(), m.max())), default=0) if m.size else 0 for m in (rows, anchors)]
    bound = largest[0] * largest[1] * max(1, rows.shape[1]) * scale
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object


class Block:
    """Rows of a block as columns, in the order of their labels, then ids."""

    def __init__(self, rows: pd.DataFrame, anchors: pd.DataFrame, scale: int):
        rows = rows.sort_values(["label", "b"], kind="stable")
        self.dims = max([len(v) // 8 for v in (*rows["q"], *anchors["q"])], default=0)
        matrix, queries = _matrix(list(rows["q"]), self.dims), _matrix(list(anchors["q"]), self.dims)
        kind = _exact_kind(matrix, queries, scale)
        self.anchors = queries.astype(kind)
        self.columns = np.ascontiguousarray(matrix.T).astype(kind)
        self.low, self.high = self.columns.min(1), self.columns.max(1)
        self.ids, self.labels = rows["b"].to_numpy(), rows["label"].to_numpy()
        self.times, self.vectors = rows["times"].to_numpy(), rows["q"].to_numpy()

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))

    def scan(self, anchor: np.ndarray, left: np.ndarray, keep: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the candidates ``left`` (places) that ``keep(lower, upper)`` never drops."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * self.low, anchor * self.high])[:, order]
        # What the dimensions from k on can add at least and at most.
        least, most = (np.append(np.cumsum(e[::-1])[::-1], 0) for e in (ends.min(0), ends.max(0)))
        partial = np.zeros(len(left), self.columns.dtype)
        for start in range(0, self.dims, STEP):
            read = order[start : start + STEP]
            partial = partial + anchor[read] @ self.columns[read][:, left]
            after = min(start + STEP, self.dims)
            bitmap = keep(partial + least[after], partial + most[after])
            if not bitmap.all():
                left, partial = left[bitmap], partial[bitmap]
            if not len(left):
                break
        if partial.dtype == object:
            partial = np.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in partial], object)
        return left, partial

    def first(self, places: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(place, score) of the first k rows by descending score, then id; a row counts as often as it occurs."""
        order = np.lexsort((self.ids[places], -scores))[:k]
        picked = [(places[i], int(scores[i])) for i in order for _ in range(min(k, int(self.times[places[i]])))]
        return picked[:k]


def _top(k: int) -> Callable:
    """Keeps what can be among the k highest scores."""

    def keep(lower, upper):
        return upper >= np.partition(lower, -k)[-k] if len(lower) > k else np.ones(len(lower), bool)

    return keep


def _in_windows(scores: Sequence[int], low: int, high: int, k: int) -> Callable:
    """Keeps what can be among the k highest of a window low * score <= 100 * x <= high * score."""

    def keep(lower, upper):
        out = np.zeros(len(lower), bool)
        for score in scores:
            can = (100 * upper >= low * score) & (100 * lower <= high * score)
            surely = lower[(100 * lower >= low * score) & (100 * upper <= high * score)]
            out |= can & (upper >= np.partition(surely, -k)[-k]) if len(surely) >= k else can
        return out

    return keep


def _cells(rows: DataFrame, anchors: DataFrame, find: Callable, schema: str, sizes: tuple[int, int]) -> DataFrame:
    """``find(block rows, anchors)`` for every pair of a block of rows and a group of anchors."""
    blocks, groups = (max(1, -(-n // size)) for n, size in zip((rows.count(), anchors.count()), sizes, strict=True))
    place = F.xxhash64("b", "label", "q")
    placed = rows.withColumn("block", F.pmod(place, F.lit(blocks)).cast("int"))
    placed = placed.withColumn("crew", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = anchors.withColumn("crew", F.pmod(place, F.lit(groups)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = list(find(left, right)) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=[part.split()[0] for part in schema.split(", ")])

    return placed.groupBy("block", "crew").cogroup(asked.groupBy("block", "crew")).applyInPandas(run, schema)


def _positives(rows: DataFrame, anchors: DataFrame, k: int, sizes: tuple[int, int]) -> DataFrame:
    """(b, label, q, place, positive, score) for the first k rows of each anchor's label; place counts from 1."""

    def find(left, right):
        block = Block(left, right, 1)
        for anchor, b, label, q in zip(block.anchors, right["b"], right["label"], right["q"], strict=True):
            own = block.of_label(label)
            # The anchor itself is no candidate; its copies are.
            places = np.arange(own.start, own.stop)
            selves = [i for i in places[block.ids[own] == b] if block.vectors[i] == q]
            places = places[~np.isin(places, [i for i in selves if block.times[i] == 1])]
            for i in selves:
                block.times[i] -= 1
            for place, score in block.first(*block.scan(anchor, places, _top(k)), k):
                yield b, label, q, int(block.ids[place]), score
            for i in selves:
                block.times[i] += 1

    found = _cells(rows, anchors, find, "b long, label long, q binary, positive long, score long", sizes)
    order = Window.partitionBy("b", "label", "q").orderBy(F.desc("score"), "positive")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    sizes: tuple[int, int] = (BLOCK, GROUP),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for vectors (vec_id, embedding, label).

    ``anchors`` is a condition on vec_id, ``label`` another label than the column, ``window`` the shares of the positive's score, in
    hundredths, between which a negative's score must lie; ``sizes`` are the rows of a block and the anchors of a group. Scores are inner
    products of floor(256 * x); higher ones come first, then smaller vec_ids, a null vec_id last. Vectors of unequal length
    are zero beyond their end. Equal rows are rows of their own: a copy of the anchor is one of its positives, a copied positive has its
    negatives once more, and a copied anchor all its rows. An anchor without positives, or a positive without negatives, gives
    no row, an empty table none at all. Components beyond a long count as the nearest long, and so do
    scores; negatives whose score is beyond a long are outside of every window. Other columns are not read.
    """
    usable = frozen(usable_rows(rows, F.col("label") if label is None else label), "vectors")
    asked = usable.withColumnRenamed("b", "vec_id").filter((F.col("vec_id") != NULL_ID) & anchors).withColumnRenamed("vec_id", "b")
    found = frozen(_positives(usable, asked, positives, sizes), "positives")
    key = ["b", "label", "q"]
    # At most ``positives`` entries for each anchor.
    entries = F.array_sort(F.collect_list(F.struct("place", "positive", "score"))).alias("entries")
    equipped = frozen(found.groupBy(*key).agg(entries).join(asked, key), "anchors")
    low, high = window

    def find(left, right):
        block = Block(left, right, 100 * max(1, abs(low), abs(high)))
        for anchor, b, label, q, entries in zip(block.anchors, right["b"], right["label"], right["q"], right["entries"], strict=True):
            own = block.of_label(label)
            others = np.concatenate([np.arange(own.start), np.arange(own.stop, len(block.ids))])
            scores = {int(e["score"]) for e in entries if low * int(e["score"]) <= high * int(e["score"])}
            if not scores:
                continue
            places, exact = block.scan(anchor, others, _in_windows(sorted(scores), low, high, negatives))
            for score in scores:
                inside = (100 * exact >= low * score) & (100 * exact <= high * score)
                for place, own_score in block.first(places[inside], exact[inside], negatives):
                    yield b, label, q, score, int(block.ids[place]), own_score

    mined = _cells(usable, equipped, find, "b long, label long, q binary, score long, negative long, negative_score long", sizes)
    order = Window.partitionBy(*key, "score").orderBy(F.desc("negative_score"), "negative")
    ranked = mined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    # Positives of equal score share a window; each has the negatives for its own.
    every = equipped.select(*key, "times", F.explode("entries").alias("e")).select(
        *key, "times", F.col("e.positive").alias("positive"), F.col("e.score").alias("score")
    )
    joined = ranked.join(every, [*key, "score"]).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return joined.select(
        F.col("b").alias("anchor_id"),
        id_or_null(F.col("positive")).alias("positive_id"),
        "rank",
        id_or_null(F.col("negative")).alias("negative_id"),
        F.col("score").alias("positive_score"),
        "negative_score",
    )
