"""Mixing sources to target weights, with DataFrame functions only.

Every source's documents are laid end to end and packed into blocks of a fixed number of words. Each slot of an output shard draws a
source, which makes the counts of a shard multinomial; slots beyond a source's quota are dealt to the sources that fell short, so the
totals are exact. The i-th slot of a source takes the block that a pseudorandom permutation of the source's block numbers gives for
i, a new permutation for every pass over the source, and slots and blocks are joined by block number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelens.llm.common import SPACE, frozen, id_or_last, id_or_null, whole_text

BLOCK_WORDS, SHARD_SLOTS, ROUNDS = 128, 4096, 16
#: Weights of the sources in code-point order, repeating; share of all words that the mix holds; passes over a source at most.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
#: Rows of one prefix-sum group, on average.
GROUP_ROWS = 50_000
#: Sources up to which their table, two short columns, is sent to every task.
MAX_BROADCAST = 100_000


def words(text: Column) -> Column:
    """Number of runs without white space."""
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long")


def _unit(*columns: Column) -> Column:
    """Pseudorandom number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """source, source_size, weight, target for (source, source_size).

    Weights repeat over the sources by code point, null last. ``share`` of all words is dealt by weight; a target stops at ``passes``
    times its source's size, and the excess is dealt again by weight until no target is above. With sources in order of
    size / weight, those that stop are the first ones: source k stops if, with all before it stopped, its share of the rest exceeds
    its limit. One row per source; the window over sources is as long as there are sources.
    """
    order = Window.orderBy(F.col("source").isNull(), F.hex(F.encode("source", "UTF-8")))
    kind = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighted = sizes.withColumn("weight", F.element_at(table, kind + 1))
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = F.col("source_size").cast("double") * passes
    rest = weighted.select(
        "*",
        (F.sum(F.col("source_size").cast("double")).over(everything) * share).alias("total"),
        F.coalesce(F.sum(limit).over(before), F.lit(0.0)).alias("given"),
        F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
    ).withColumn("level", (F.col("total") - F.col("given")) / F.col("open"))
    stops = F.col("level") * F.col("weight") >= limit
    # The level only rises as sources stop, so the first one that does not stop sets it for all that follow.
    level = F.min(F.when(~stops, F.struct("given", "level"))).over(everything)["level"]
    return rest.withColumn("final", level).select(
        "source", "source_size", "weight", F.when(stops, limit).otherwise(F.least(limit, F.col("final") * F.col("weight"))).alias("target")
    )


def _running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``name``: sum of ``value`` over what comes earlier in keys[:-1], by keys[-1] and then by ``order``.

    The last key cuts each group into buckets. Buckets are summed and the sums run over; then the rows of a bucket are. No group is
    in one task.
    """
    over = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    starts = sums.select(*keys, F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_start"))
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, keys)
        .withColumn(name, (F.col("_start") + F.col("_inside")).cast("long"))
        .drop("_start", "_inside")
    )


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df``, written, with ``name``: 0, 1, … over the rows that agree in ``keys``, in any order; a key may hold any share of the rows."""
    placed = frozen(df.withColumn("_at", F.monotonically_increasing_id()), "rows")
    parts = placed.withColumn("_part", F.floor(F.col("_at") / GROUP_ROWS)).withColumn("_one", F.lit(1).cast("long"))
    return _running(parts, [*keys, "_part"], ["_at"], "_one", name).drop("_at", "_part", "_one")


def _each_row(placed: DataFrame) -> DataFrame:
    """A row for each of ``rows`` equal ones, laid end to end from ``first`` on: ``start``. They are unfolded in groups of ``GROUP_ROWS``."""
    groups = placed.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / GROUP_ROWS))))
    dealt = groups.repartition("source_no", "b", "sig", "group")
    last = F.least(F.col("rows"), (F.col("group") + 1) * GROUP_ROWS) - 1
    each = dealt.withColumn("row", F.explode(F.sequence(F.col("group") * GROUP_ROWS, last)))
    return each.select("source_no", "b", "sig", "size", (F.col("first") + F.col("row") * F.col("size")).alias("start"))


def _within(rows: DataFrame, at: str, ranges: DataFrame, total: int) -> DataFrame:
    """Join each row to the range [low, high) that holds ``at``. Ranges are cut at cells of equal width, and cells are joined."""
    width = max(1, total // 1024)
    cells = ranges.filter("high > low").withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width)))
    )
    held = rows.withColumn("_cell", F.floor(F.col(at) / width)).join(cells, "_cell")
    return held.filter((F.col(at) >= F.col("low")) & (F.col(at) < F.col("high"))).drop("_cell")


def permuted(index: Column, n: Column, seed: Column) -> Column:
    """Place of ``index`` in a pseudorandom permutation of 0 … n-1: swap-or-not rounds, exact for every n.

    In a round, i and its partner (k - i) mod n change places or not, as a hash of the larger of the two decides.
    """

    def one(i: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(seed, r), n) - i, n)
        return F.when(F.pmod(F.xxhash64(seed, r, F.greatest(i, partner), F.lit(7)), F.lit(2)) == 0, i).otherwise(partner)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, one)


class Mixture:
    """Tables of a mix.

    ``docs``: b (doc_id, null last), sig (hash of the text), source_no, size, start (place of the first word in the source).
    ``sources``: source, source_no, source_size, target, blocks, quota.
    ``slots``: shard, slot, source_no, block: what every slot of every output shard holds.

    A null text has no words. A null source is a source of its own. Rows that repeat a document are placed each. Quotas are whole
    blocks, so a target is met to about a block. Empty tables give empty tables.
    """

    def __init__(self, documents: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES,
                 block_words: int = BLOCK_WORDS, seed: int = 1):
        text = whole_text()
        rows = frozen(
            documents.select(
                id_or_last(F.col("doc_id")).alias("b"), F.xxhash64(text).alias("sig"), "source", words(text).alias("size")
            ),
            "sizes",
        )
        n = rows.count()
        self.block_words, self.seed = block_words, seed
        sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        by_name = Window.orderBy(F.col("source").isNull(), "source")
        blocks = F.ceil(F.col("source_size") / block_words).cast("long")
        quota = F.round(F.try_divide("target", "source_size") * F.col("blocks")).cast("long")
        self.sources = frozen(
            source_targets(sizes, weights, share, passes)
            .withColumn("blocks", blocks)
            .withColumn("quota", F.coalesce(F.least(quota, F.col("blocks") * passes), F.lit(0)))
            .withColumn("source_no", F.row_number().over(by_name)),
            "sources",
        )
        named = F.broadcast(self.sources) if self.sources.count() <= MAX_BROADCAST else self.sources
        numbered = rows.join(named.select("source", "source_no"), rows["source"].eqNullSafe(named["source"])).drop("source")
        # Equal rows are placed as one and then told apart; a document may be any share of the rows.
        bucket = F.pmod(F.xxhash64("b", "sig"), F.lit(max(64, n // GROUP_ROWS)))
        distinct = numbered.groupBy("source_no", "b", "sig", "size").agg(F.count("*").alias("rows"))
        distinct = distinct.withColumn("bucket", bucket).withColumn("held", F.col("size") * F.col("rows"))
        placed = _running(distinct, ["source_no", "bucket"], ["b", "sig", "size"], "held", "first")
        self.docs = frozen(_each_row(placed.drop("bucket", "held")), "placed")
        self.slots = frozen(self._slots(), "slots")

    def _slots(self) -> DataFrame:
        spark = self.sources.sparkSession
        total = self.sources.agg(F.sum("quota")).first()[0] or 0
        by_no = Window.orderBy("source_no")
        ranges = self.sources.select("source_no", "quota", F.sum("quota").over(by_no).alias("high"))
        ranges = ranges.select("source_no", (F.col("high") - F.col("quota")).alias("low"), "high")
        place = F.least(F.floor(_unit(F.lit(self.seed), F.col("id")) * total), F.lit(max(total - 1, 0))).cast("long")
        slots = spark.range(total).select(
            F.floor(F.col("id") / SHARD_SLOTS).cast("long").alias("shard"), F.pmod("id", F.lit(SHARD_SLOTS)).alias("slot"), place.alias("at")
        )
        drawn = _within(slots, "at", ranges, total).select("source_no", "shard", "slot", F.lit(1).cast("long").alias("one"))
        drawn = frozen(_running(drawn, ["source_no", "shard"], ["slot"], "one", "i").drop("one"), "drawn")
        # Slots beyond a quota, laid end to end, meet what other sources lack, laid end to end.
        counts = drawn.groupBy("source_no").agg(F.count("*").alias("n"))
        drawn_n = F.coalesce("n", F.lit(0))
        gaps = self.sources.join(counts, "source_no", "left").select(
            "source_no", "quota", "blocks", drawn_n.alias("n"),
            F.greatest(drawn_n - F.col("quota"), F.lit(0)).alias("over"), F.greatest(F.col("quota") - drawn_n, F.lit(0)).alias("under"),
        )
        gaps = frozen(
            gaps.select("*", F.sum("over").over(by_no).alias("over_to"), F.sum("under").over(by_no).alias("under_to")), "gaps"
        )
        moved = gaps.agg(F.sum("over")).first()[0] or 0
        own = drawn.join(gaps.select("source_no", "quota", "blocks", (F.col("over_to") - F.col("over")).alias("from")), "source_no")
        kept = own.filter("i < quota").select("shard", "slot", "source_no", "i", "blocks")
        spare = own.filter("i >= quota").select("shard", "slot", (F.col("from") + F.col("i") - F.col("quota")).alias("at"))
        wants = gaps.select(
            "source_no", "n", "blocks", (F.col("under_to") - F.col("under")).alias("low"), F.col("under_to").alias("high")
        )
        given = _within(spare, "at", wants, moved).select(
            "shard", "slot", "source_no", (F.col("n") + F.col("at") - F.col("low")).alias("i"), "blocks"
        )
        turn = F.floor(F.col("i") / F.col("blocks"))
        block = permuted(F.pmod("i", "blocks"), F.col("blocks"), F.xxhash64(F.lit(self.seed), F.col("source_no"), turn))
        return kept.unionByName(given).select("shard", "slot", "source_no", block.alias("block"))

    def pieces(self) -> DataFrame:
        """The mix itself: (shard, slot) and the words ``first`` … ``first + n_words - 1`` of the document at (source_no, start)."""
        size = self.block_words
        last = F.col("start") + F.col("size")
        parts = (
            self.docs.filter("size > 0")
            .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((last - 1) / size))))
            .withColumn("low", F.greatest(F.col("start"), F.col("block") * size))
            .withColumn("n_words", F.least(last, (F.col("block") + 1) * size) - F.col("low"))
            .withColumn("first", F.col("low") - F.col("start"))
        )
        return self.slots.join(parts, ["source_no", "block"]).select(
            "shard", "slot", "source_no", "start", "b", "sig", "first", "n_words"
        )

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken of every document."""
        taken = self.pieces().groupBy("source_no", "start").agg(F.sum("n_words").alias("taken"))
        with_words = self.docs.filter("size > 0").join(taken, ["source_no", "start"], "left")
        without = self.docs.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
        sources = self.sources.select("source_no", "source_size", "target")
        return (
            with_words.unionByName(without)
            .join(sources, "source_no")
            .select(
                id_or_null(F.col("b")).alias("doc_id"), "size", "source_size", "target",
                F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
            )
        )

    def copies(self) -> DataFrame:
        """source, source_no, b, sig, copies, rows: how often the mix takes the first word of the rows of a document, and how many rows there are. Whole
        documents in these numbers meet the targets on average. A row without words has one copy."""
        firsts = self.pieces().filter("first = 0").groupBy("source_no", "start").agg(F.count("*").alias("copies"))
        # Rows without words stand at the start of the next document, so they are kept out of the join.
        with_words = self.docs.filter("size > 0").join(firsts, ["source_no", "start"], "left")
        every = with_words.select("source_no", "b", "sig", F.coalesce("copies", F.lit(0)).alias("copies")).unionByName(
            self.docs.filter("size = 0").select("source_no", "b", "sig", F.lit(1).alias("copies"))
        )
        counted = every.groupBy("source_no", "b", "sig").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
        return counted.join(self.sources.select("source", "source_no"), "source_no")
