"""Exact deduplication through a sharded cuckoo index of text digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import SPACE, frozen, id_or_last, id_or_null, spread, whole_text
from farelens.llm.cuckoo import index_answers, index_state, remove


def digests(docs: DataFrame) -> DataFrame:
    """Per row: b (doc_id, null last), a (minus the code points of the text), key (SHA-256 of the text without white space)."""
    text = whole_text()
    return docs.select(
        id_or_last(F.col("doc_id")).alias("b"),
        (-F.char_length(text)).cast("long").alias("a"),
        F.unhex(F.sha2(F.translate(text, SPACE, ""), 256)).alias("key"),
    )


def _summed(rows: DataFrame, n: int) -> DataFrame:
    """Rows of a (key, salt) in one, summed before and after the shuffle; a hot key ends as a row for each salt."""
    return (
        rows.groupBy("key", spread(F.col("b"), n).alias("salt"))
        .agg(F.count("*").alias("refs"), F.min(F.struct("a", "b")).alias("best"), F.max("b").alias("top"))
        .select("key", "salt", "refs", "best.a", "best.b", "top")
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256; one row for each row of ``docs``.

    Texts are equal when they agree after white space is deleted. The longest original stays, then the smallest doc_id. A null text
    is empty; all empty texts are one group. A null doc_id comes after all others. Rows that repeat a doc_id and its text count in
    group_size, and share its decision. Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    rows = frozen(digests(docs), "digests")
    n = rows.count()
    answers = index_answers(_summed(rows, n), n).select("key", "salt", "refs", F.col("b").alias("keep"))
    return (
        rows.withColumn("salt", spread(F.col("b"), n))
        .join(answers, ["key", "salt"])
        .select(
            id_or_null(F.col("b")).alias("doc_id"),
            id_or_null(F.col("keep")).alias("keep_id"),
            F.col("refs").alias("group_size"),
            (F.col("b") == F.col("keep")).alias("kept"),
            F.lower(F.hex("key")).alias("text_sha256"),
        )
    )


class ExactIndex:
    """Live digests that documents join and leave: state rows of the filters, and the members behind them.

    ``capacity`` is the number of live documents to plan shards for; more than that only makes shards larger.
    """

    def __init__(self, capacity: int = 1_000_000):
        self.capacity = capacity
        self.members: DataFrame | None = None
        self.state: DataFrame | None = None

    def insert(self, docs: DataFrame) -> None:
        rows = frozen(digests(docs), "members")
        changes = _summed(rows, rows.count()).withColumn("kind", F.lit(1))
        self.state = frozen(index_state(self.state, changes, self.capacity), "index")
        self.members = rows if self.members is None else self.members.unionByName(rows)

    def delete(self, ids: DataFrame) -> None:
        """Remove the documents whose doc_id is in ``ids``."""
        gone = ids.select(id_or_last(F.col("doc_id")).alias("b"))
        self.state = frozen(remove(self.state, self.members, gone, self.capacity), "index")
        self.members = frozen(self.members.join(gone, "b", "left_anti"), "members")

    def live(self) -> DataFrame:
        """text_sha256, group_size, keep_id of every live digest."""
        return self.state.select(
            F.lower(F.hex("key")).alias("text_sha256"), F.col("refs").alias("group_size"), id_or_null(F.col("b")).alias("keep_id")
        )
