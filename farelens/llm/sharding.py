"""Sharding by extendible hashing, with DataFrame functions only.

The directory is indexed by leading bits of a hash of the row. A bucket that exceeds the byte limit splits on its next bit, and only
such a bucket does, until every shard fits. All depths of a directory of DEPTH bits are decided at once: bytes are counted for the
finest buckets, summed up for every shorter prefix, and the shortest prefix that fits is a shard. Buckets that are too large even at
the last bit go on to the next DEPTH bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import frozen, id_or_last, id_or_null, whole_text

#: Bytes of a shard at most.
LIMIT = 8 << 20
#: Bits of one directory above those that shards of just the limit would need; bits of the hash in all.
SPARE_BITS, HASH_BITS = 5, 128


def hash_bits(column: Column) -> Column:
    """The 128 bits of a hash as a text of 0 and 1. MD5 only spreads rows here."""
    digest = F.md5(column)
    halves = [F.lpad(F.conv(F.substring(digest, k, 8), 16, 2), 32, "0") for k in (1, 9, 17, 25)]
    return F.concat(*halves)


def directory(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """Shards of rows (bits, n_bytes), for each number of leading bits that buckets were counted by: (leaf, shard, shard_bytes).

    A leaf, so many leading bits of a row, names the row's shard: the shortest of its prefixes whose rows fit the limit. Leaves that
    need more bits are in the next entry. A single hash that exceeds the limit alone, one huge text or equal rows, is a shard by
    itself: no bit can split it.
    """
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = max(1, math.ceil(math.log2(max(1.0, total / limit)))) + SPARE_BITS
    out, left, base = [], rows, 0
    while True:
        top = min(base + depth, HASH_BITS)
        leaf = F.substring("bits", 1, top)
        fine = frozen(left.groupBy(leaf.alias("leaf")).agg(F.sum("n_bytes").alias("n_bytes")), "leaves")
        prefix = F.expr("substring(leaf, 1, depth)").alias("shard")
        every = fine.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(top)))).select("leaf", "n_bytes", "depth", prefix)
        sums = every.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
        fits = (F.col("shard_bytes") <= limit) | (F.length("shard") == HASH_BITS)
        fit = sums.filter(fits)
        # Bytes shrink from prefix to longer prefix, so the first that fits is the shortest.
        first = every.select("leaf", "depth", "shard").join(fit, "shard").groupBy("leaf").agg(
            F.min(F.struct("depth", "shard", "shard_bytes")).alias("first")
        )
        found = frozen(first.select("leaf", "first.shard", "first.shard_bytes"), "directory")
        out.append((top, found))
        over = fine.join(found, "leaf", "left_anti").select("leaf")
        if top == HASH_BITS or over.isEmpty():
            return out
        left = left.withColumn("leaf", leaf).join(over, "leaf", "left_semi").drop("leaf")
        base = top


def _placed(rows: DataFrame, found: list[tuple[int, DataFrame]]) -> DataFrame:
    """Rows with their shard and its bytes, by their leaf."""
    out = None
    for top, shards in found:
        own = rows.withColumn("leaf", F.substring("bits", 1, top)).join(shards, "leaf").drop("leaf")
        out = own if out is None else out.unionByName(own)
    return out


def _key() -> Column:
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), whole_text())


def shard_rows(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, shard (its hash prefix), depth, shard_bytes and oversized of every row of ``docs``.

    Bytes are those of the text in UTF-8; null counts as empty. Rows are hashed by doc_id and text, so a doc_id that repeats with other
    texts spreads. Rows that agree in both cannot be told apart and stay together; together with single texts above the limit they
    are the only oversized shards. A null doc_id hashes as an empty text. An empty table gives an empty result.
    """
    size = F.octet_length(whole_text()).cast("long").alias("n_bytes")
    rows = frozen(docs.select(id_or_last(F.col("doc_id")).alias("b"), size, hash_bits(_key()).alias("bits")), "hashed")
    return _placed(rows, directory(rows.select("bits", "n_bytes"), limit)).select(
        id_or_null(F.col("b")).alias("doc_id"), "n_bytes", "shard", F.length("shard").alias("depth"), "shard_bytes",
        (F.col("shard_bytes") > limit).alias("oversized"),
    )


def write_shards(docs: DataFrame, folder: str, limit: int = LIMIT) -> None:
    """Write ``docs`` as Parquet, one folder for each shard: shard=p<prefix>. A shard is one file unless it is oversized.

    Where ``docs`` has a column of that name, in any case of letters, the folders' name gets underscores behind it until it has none.
    """
    name = "shard"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    size = F.octet_length(whole_text()).cast("long").alias("n_bytes")
    rows = docs.select(row, size, hash_bits(_key()).alias("bits"))
    placed = _placed(rows, directory(rows.select("bits", "n_bytes"), limit))
    named = placed.select("_row.*", F.concat(F.lit("p"), "shard").alias(name))
    named.repartition(name).write.partitionBy(name).parquet(folder)
