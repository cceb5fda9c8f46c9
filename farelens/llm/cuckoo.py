"""Cuckoo filters in shards, each backed by the exact keys it stands for.

A shard's filter is a table of buckets with four slots. A slot holds a 16-bit fingerprint; beside it, at the same place, lies the
bucket's content: the whole key and its counts. A lookup compares fingerprints in two buckets and verifies every hit against the
content, so answers are exact. When an insertion finds no free slot after many moves, the table doubles and is filled anew from its
stored keys. The state of a shard is a set of rows (shard, buckets, slot, key, refs, a, b, top), so it can be kept as a table.

``refs`` counts what refers to a key; (a, b) is the smallest pair seen for it; ``top`` is the largest b.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.llm.common import partitions

SLOTS = 4
MOVES = 200
#: Shards at least, and keys in a shard at most (more keys: more shards).
SHARDS, SHARD_KEYS = 1024, 200_000
STATE = "shard int, buckets int, slot int, key binary, refs long, a long, b long, top long"
ANSWER = "key binary, salt int, refs long, a long, b long, top long"


class CuckooIndex:
    """One shard: fingerprints, and key and counts at the same slots."""

    def __init__(self, buckets: int = 8):
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.prints = [0] * (buckets * SLOTS)
        self.keys: list[bytes | None] = [None] * (buckets * SLOTS)
        self.values: list[list[int] | None] = [None] * (buckets * SLOTS)

    @staticmethod
    def _print(key: bytes) -> int:
        return int.from_bytes(key[4:6], "little") or 1

    def _first(self, key: bytes) -> int:
        return int.from_bytes(key[6:10], "little") & (self.buckets - 1)

    def _other(self, bucket: int, fingerprint: int) -> int:
        return (bucket ^ (fingerprint * 0x5BD1E995)) & (self.buckets - 1)

    def find(self, key: bytes) -> int:
        """Slot of the key, or -1. A fingerprint that hits is verified against the stored key."""
        fingerprint, bucket = self._print(key), self._first(key)
        for place in (bucket, self._other(bucket, fingerprint)):
            for slot in range(place * SLOTS, place * SLOTS + SLOTS):
                if self.prints[slot] == fingerprint and self.keys[slot] == key:
                    return slot
        return -1

    def insert(self, key: bytes, value: list[int]) -> None:
        """Store a key that is not there yet; the table doubles when no slot can be freed."""
        fingerprint, bucket = self._print(key), self._first(key)
        for place in (bucket, self._other(bucket, fingerprint)):
            for slot in range(place * SLOTS, place * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.keys[slot], self.values[slot] = fingerprint, key, value
                    return
        place = bucket
        for move in range(MOVES):
            slot = place * SLOTS + (move * 7 + fingerprint) % SLOTS
            fingerprint, self.prints[slot] = self.prints[slot], fingerprint
            key, self.keys[slot] = self.keys[slot], key
            value, self.values[slot] = self.values[slot], value
            place = self._other(place, fingerprint)
            for free in range(place * SLOTS, place * SLOTS + SLOTS):
                if not self.prints[free]:
                    self.prints[free], self.keys[free], self.values[free] = fingerprint, key, value
                    return
        stored = [*self.items(), (key, value)]
        self._clear(self.buckets * 2)
        for k, v in stored:
            self.insert(k, v)

    def delete(self, key: bytes) -> bool:
        """Free the key's slot."""
        slot = self.find(key)
        if slot < 0:
            return False
        self.prints[slot], self.keys[slot], self.values[slot] = 0, None, None
        return True

    def place(self, slot: int, key: bytes, value: list[int]) -> None:
        """Put a stored key back where it was."""
        self.prints[slot], self.keys[slot], self.values[slot] = self._print(key), key, value

    def add(self, key: bytes, refs: int, a: int, b: int, top: int) -> None:
        """Insert, or on a verified hit raise the counts."""
        slot = self.find(key)
        if slot < 0:
            self.insert(key, [refs, a, b, top])
        else:
            value = self.values[slot]
            value[0] += refs
            value[1], value[2] = min((value[1], value[2]), (a, b))
            value[3] = max(value[3], top)

    def take(self, key: bytes, refs: int) -> None:
        """Lower the count; at zero the fingerprint goes."""
        slot = self.find(key)
        if slot >= 0:
            self.values[slot][0] -= refs
            if self.values[slot][0] <= 0:
                self.delete(key)

    def set_best(self, key: bytes, a: int, b: int, top: int) -> None:
        slot = self.find(key)
        if slot >= 0:
            self.values[slot][1:] = [a, b, top]

    def items(self) -> Iterator[tuple[bytes, list[int]]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)


def _by_shard(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Iterator]]:
    """Rows of one shard after another; the rows come sorted by shard."""
    rows = chain.from_iterable(pdf.itertuples(index=False, name=None) for pdf in batches)
    row = next(rows, None)
    while row is not None:
        shard = row[0]

        def own(first, shard=shard):
            nonlocal row
            row = first
            while row is not None and row[0] == shard:
                yield row
                row = next(rows, None)

        yield shard, own(row)


def _frames(rows: Iterator[tuple], columns: list[str], size: int = 20_000) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def _load(rows: Iterator, seen: list | None = None) -> CuckooIndex:
    """Index of a shard from rows (shard, kind, buckets, slot, key, salt, refs, a, b, top), stored rows (kind 0) first."""
    index = None
    for _, kind, buckets, slot, key, salt, refs, a, b, top in rows:
        if index is None:
            index = CuckooIndex(int(buckets)) if kind == 0 else CuckooIndex()
        key, refs, a, b, top = bytes(key), int(refs), int(a), int(b), int(top)
        if kind == 0:
            index.place(int(slot), key, [refs, a, b, top])
        elif kind == 1:
            index.add(key, refs, a, b, top)
            if seen is not None:
                seen.append((key, int(salt)))
        elif kind == 2:
            index.take(key, refs)
        else:
            index.set_best(key, a, b, top)
    return index


def _dealt(state: DataFrame | None, changes: DataFrame, keys: int) -> DataFrame:
    """State and changes, the rows of a shard together, stored rows first. A shard is named by the first bits of a key."""
    shards = SHARDS
    while shards * SHARD_KEYS < keys:
        shards *= 2
    named = F.pmod(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")
    rows = changes.select(
        named.alias("shard"), "kind", F.lit(0).alias("buckets"), F.lit(0).alias("slot"), "key", "salt", "refs", "a", "b", "top"
    )
    if state is not None:
        stored = state.select("shard", F.lit(0).alias("kind"), "buckets", "slot", "key", F.lit(0).alias("salt"), "refs", "a", "b", "top")
        rows = stored.unionByName(rows)
    return rows.repartition(partitions(changes.sparkSession), "shard").sortWithinPartitions("shard", "kind")


def index_answers(changes: DataFrame, keys: int) -> DataFrame:
    """Insert (key, salt, refs, a, b, top) into empty filters; for each row inserted, the final counts of its key.

    The caller has summed the rows of a (key, salt), so a key brings no more rows than there are salts.
    """

    def run(batches):
        def rows():
            for _, own in _by_shard(batches):
                seen: list = []
                index = _load(own, seen)
                for key, salt in seen:
                    yield (key, salt, *index.values[index.find(key)])

        yield from _frames(rows(), ["key", "salt", "refs", "a", "b", "top"])

    return _dealt(None, changes.withColumn("kind", F.lit(1)), keys).mapInPandas(run, ANSWER)


def index_state(state: DataFrame | None, changes: DataFrame, keys: int) -> DataFrame:
    """State after changes (kind, key, salt, refs, a, b, top): kind 1 inserts, 2 takes references back, 3 sets the best pair.

    ``keys`` must give the same number of shards as it did for the state.
    """

    def run(batches):
        def rows():
            for shard, own in _by_shard(batches):
                index = _load(own)
                for slot, key in enumerate(index.keys):
                    if key is not None:
                        yield (shard, index.buckets, slot, key, *index.values[slot])

        yield from _frames(rows(), ["shard", "buckets", "slot", "key", "refs", "a", "b", "top"])

    return _dealt(state, changes, keys).mapInPandas(run, STATE)


def remove(state: DataFrame, members: DataFrame, removed: DataFrame, keys: int) -> DataFrame:
    """State without the members whose ``b`` is in ``removed``; keys that lose their best pair get the next one.

    members: (key, a, b) of everything that is live, the removed ones included.
    """
    gone = removed.select("b").distinct()
    out = members.join(gone, "b", "left_semi")
    salt = F.pmod(F.xxhash64("b"), F.lit(64)).cast("int").alias("salt")
    taken = (
        out.groupBy("key", salt)
        .agg(F.count("*").alias("refs"))
        .select(F.lit(2).alias("kind"), "key", "salt", "refs", *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "top")])
    )
    best = (
        members.join(gone, "b", "left_anti")
        .join(out.select("key").distinct(), "key", "left_semi")
        .groupBy("key")
        .agg(F.min(F.struct("a", "b")).alias("best"), F.max("b").alias("top"))
        .select(
            F.lit(3).alias("kind"), "key", F.lit(0).alias("salt"), F.lit(0).cast("long").alias("refs"), "best.a", "best.b", "top"
        )
    )
    return index_state(state, taken.unionByName(best), keys)
