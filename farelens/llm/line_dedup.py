"""Line deduplication through sharded cuckoo filters with exact reference counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import NULL_ID, SPACE, ascii_lower, frozen, id_or_last, id_or_null, spread, whole_text
from farelens.llm.cuckoo import index_answers, index_state, remove

#: Code points from which on a line counts.
MIN_POINTS = 10


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_members(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """Lines that count: b (doc_id, null last), sig (hash of the text, tells rows of one doc_id apart), pos, key (128-bit digest), a = 0."""
    text = whole_text()
    split = docs.select(
        id_or_last(F.col("doc_id")).alias("b"),
        F.xxhash64(text).alias("sig"),
        F.posexplode(_lines(ascii_lower(text))).alias("pos", "line"),
    ).withColumn("line", F.trim(F.col("line"), F.lit(SPACE)))
    return split.filter(F.char_length("line") >= min_points).select(
        "b", "sig", "pos", F.unhex(F.substring(F.sha2("line", 256), 1, 32)).alias("key"), F.lit(0).cast("long").alias("a")
    )


def _summed(members: DataFrame, n: int) -> DataFrame:
    return (
        members.groupBy("key", spread(F.col("b"), n).alias("salt"))
        .agg(F.count("*").alias("refs"), F.min("b").alias("b"), F.max("b").alias("top"))
        .select("key", "salt", "refs", F.lit(0).cast("long").alias("a"), "b", "top")
    )


def repeated_lines(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """Lines to drop: b, sig, and ``drop``, the positions of a document's lines whose key an earlier document holds too.

    Documents go by doc_id, and those without one, after all others, by the hash of their text.
    """
    members = frozen(line_members(docs, min_points), "lines")
    n = members.count()
    unnamed = F.col("b") == NULL_ID
    own = F.when(unnamed, F.col("sig")).otherwise(F.col("b"))
    members = members.select(
        "b", "sig", "pos", "key", unnamed.cast("long").alias("a"), own.alias("own"), spread(own, n).alias("salt")
    )
    best = F.min(F.struct("a", "own")).alias("best")
    summed = members.groupBy("key", "salt").agg(F.count("*").alias("refs"), best, F.max("b").alias("top"))
    summed = summed.select("key", "salt", "refs", "best.a", F.col("best.own").alias("b"), "top")
    # Keys of texts without doc_id may still have one document only; the comparison below leaves them out.
    several = (F.col("refs") > 1) & ((F.col("a") > 0) | (F.col("b") < F.col("top")))
    shared = index_answers(summed, n).filter(several).select("key", "salt", F.col("a").alias("first_a"), F.col("b").alias("first"))
    return (
        members.join(shared, ["key", "salt"])
        .filter("a <> first_a or own <> first")
        .groupBy("b", "sig")
        .agg(F.collect_set("pos").alias("drop"))
    )


def drop_repeated_lines(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """``docs`` with column ``_lines``: struct(n_lines, n_dropped, kept), kept being the text without repeated lines.

    A line's key is the line without white space at its ends and with A-Z lower-cased. A key of ``min_points`` code points that
    several documents hold keeps its lines in the one of the smallest doc_id only. Null and empty texts are one empty line, which is too short to
    count; a null text stays null where ``docs`` is returned. Rows that share a doc_id are one document: a line that only they hold
    stays. Rows without doc_id come after all others, each text a document, by the hash of the text; equal ones are one. Texts of any length are one row each.
    """
    text = whole_text("_row.text")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = packed.select("_row", id_or_last(F.col("_row.doc_id")).alias("b"), F.xxhash64(text).alias("sig"))
    lines = _lines(text)
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop")), lambda p: F.element_at(lines, p + 1)
    )
    # A column with the lines would copy every text; only rows with something to drop are split.
    touched = F.col("drop").isNotNull()
    return (
        rows.join(repeated_lines(docs, min_points), ["b", "sig"], "left")
        .withColumn("_n", F.size(lines))
        .withColumn("_left", F.when(touched, kept))
        .select(
            "_row.*",
            F.struct(
                F.col("_n").cast("long").alias("n_lines"),
                F.when(touched, F.col("_n") - F.size("_left")).otherwise(0).cast("long").alias("n_dropped"),
                F.when(touched, F.array_join("_left", "\n")).otherwise(text).alias("kept"),
            ).alias("_lines"),
        )
    )


class LineIndex:
    """Reversible line index: documents join and leave, and the state is as if only the live ones had ever come.

    ``capacity`` is the number of live lines to plan shards for. A doc_id is inserted once.
    """

    def __init__(self, capacity: int = 1_000_000, min_points: int = MIN_POINTS):
        self.capacity, self.min_points = capacity, min_points
        self.members: DataFrame | None = None
        self.state: DataFrame | None = None

    def insert(self, docs: DataFrame) -> None:
        rows = frozen(line_members(docs, self.min_points), "members")
        changes = _summed(rows, rows.count()).withColumn("kind", F.lit(1))
        self.state = frozen(index_state(self.state, changes, self.capacity), "index")
        self.members = rows if self.members is None else self.members.unionByName(rows)

    def delete(self, ids: DataFrame) -> None:
        """Take back every line of the documents whose doc_id is in ``ids``."""
        gone = ids.select(id_or_last(F.col("doc_id")).alias("b"))
        self.state = frozen(remove(self.state, self.members, gone, self.capacity), "index")
        self.members = frozen(self.members.join(gone, "b", "left_anti"), "members")

    def counts(self) -> DataFrame:
        """key, refs (lines) and the smallest doc_id of every live key."""
        return self.state.select("key", "refs", id_or_null(F.col("b")).alias("first_id"))
