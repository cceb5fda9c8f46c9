"""Exact quantiles without holding a whole group in one task.

The built-in exact percentile keeps every distinct value of a group in one reducer. Two searches for ranks do not:

``table_ranks`` is for columns of a whole table. A mergeable rank sketch of fixed size, taken for all columns in one aggregation, names a
bracket around every wanted rank. A second pass counts the rows below the bracket and keeps only values inside it. The counts prove which
value has the rank: a sketch steers the search and never decides it. The passes run when it is called, as the fit of an estimator
does, and give plain figures. A bracket that holds too many values, or that missed its rank, is narrowed by a further pass.

``ranked_values`` is for groups and stays lazy. A sketch would not do there: a lazy plan may take it twice, and two sketches of the same
rows differ. Cells of the value itself are counted instead, then the values of the cells that hold a rank.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Resolution of the one-pass approximation.
ACCURACY = 10_000
# Size of a sketch, points read from it, and half the width of a bracket as a share of all rows; the sketch's error is a third of that.
TABLE_SKETCH, TABLE_POINTS, TABLE_REACH = 8_000, 500, 0.001
# Values inside a bracket that a pass hands to the driver; a bracket with more is narrowed first.
KEPT = 50_000
# Cells for each doubling of a value.
_COARSE = 256
_NOT_A_NUMBER, _ENDLESS = 1 << 30, (1 << 30) - 1


def quoted(name: str) -> str:
    """Column name for use in a SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def _level(value: str) -> str:
    """SQL for a number that never falls where the value rises: the logarithm does not, by the rules of the virtual machine."""
    return f"(signum({value}) * log2(1D + abs({value})) * {_COARSE}D)"


def coarse_cell(value: str = "value") -> Column:
    """Whole number in the order of the values; null gives null, NaN is largest."""
    v = quoted(value)
    return F.expr(
        f"int(CASE WHEN isnan({v}) THEN {_NOT_A_NUMBER} WHEN abs({v}) = double('Infinity') THEN signum({v}) * {_ENDLESS} ELSE floor({_level(v)}) END)"
    )


def first_cells(
    rows: DataFrame, keys: Sequence[str], ranks: Callable[[Column, Column], Column]
) -> DataFrame:
    """For each wanted rank of a group: cell ``a``, ``rank``, and ``inner``, the rank within the cell.

    ``ranks`` gives the array of wanted ranks, from 1 on, for a group's number of values and of nulls, which come along as ``size``
    and ``nulls``.
    """
    cells = rows.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("k"))
    whole = Window.partitionBy(*keys)
    is_value = F.col("a").isNotNull()
    order = whole.orderBy(F.col("a").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(is_value, F.col("k")).otherwise(0)
    counted = cells.select(
        "*",
        F.sum(known).over(whole).alias("size"),
        F.sum(F.col("k") - known).over(whole).alias("nulls"),
        F.sum(known).over(order).alias("_upto"),
    )
    own = F.filter(
        F.array_distinct(ranks(F.col("size"), F.col("nulls"))),
        lambda r: (r <= F.col("_upto")) & (r > F.col("_upto") - F.col("k")),
    )
    found = counted.filter(is_value).withColumn("rank", F.explode(own))
    inner = F.col("rank") - F.col("_upto") + F.col("k")
    return found.select(*keys, "size", "nulls", "a", "rank", inner.alias("inner"))


def ranked_values(rows: DataFrame, keys: Sequence[str], ranks: Callable[[Column, Column], Column]) -> DataFrame:
    """(keys, size, nulls, rank, value) for each wanted rank of the column ``value`` in each group; see ``first_cells``.

    1. One aggregation counts each group's values by coarse cell (256 for each doubling), in part before the shuffle; running counts name
       the cell that holds a wanted rank.
    2. A second one counts the values in these cells, and running counts over them end at the value.

    Cells keep the order of the values, so no rank can be missed, and equal values never add up in one task. A running count goes
    over the coarse cells of a group, or over the distinct values of one cell, which is 0.3 percent of its value wide; both are sorted with
    room on disk. The rows are read twice.
    """
    keys = list(keys)
    celled = rows.withColumn("a", coarse_cell())
    picks = first_cells(celled, keys, ranks)
    # At most one entry for each wanted rank of the group.
    wanted = picks.groupBy(*keys, "a", "size", "nulls").agg(F.collect_list(F.struct("rank", F.col("inner").alias("at"))).alias("wanted"))
    opened = celled.join(wanted, [*keys, "a"])
    counts = opened.groupBy(*keys, "a", "size", "nulls", "wanted", "value").agg(F.count(F.lit(1)).alias("k"))
    order = Window.partitionBy(*keys, "a").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    own = F.filter("wanted", lambda w: (w["at"] <= F.col("upto")) & (w["at"] > F.col("upto") - F.col("k")))
    found = counts.withColumn("upto", F.sum("k").over(order)).withColumn("own", F.explode(own))
    return found.select(*keys, "size", "nulls", F.col("own.rank").alias("rank"), "value")


def _points(sketch: str, points: int) -> str:
    """SQL for the values at evenly spaced shares of a sketch."""
    return f"kll_sketch_get_quantile_double({sketch}, array({', '.join(f'{k / points!r}D' for k in range(points + 1))}))"


def _sketch(value: str, size: int) -> str:
    return f"kll_sketch_agg_double({value}, {size})"


def _bracket(points: Sequence[float], rank: int, size: int, reach: float) -> tuple[float, float]:
    """Two points around a rank among ``size`` values; endless where the reach goes beyond the ends."""
    share, last = (rank - 0.5) / size, len(points) - 1
    low, high = math.floor((share - reach) * last), math.ceil((share + reach) * last)
    return points[low] if low >= 0 else -math.inf, points[high] if high <= last else math.inf


@dataclass
class ColumnRanks:
    """Number of values and nulls of a column, and the value at each rank asked for. NaN counts as the largest value."""

    size: int
    nulls: int
    values: dict[int, float] = field(default_factory=dict)


@dataclass
class _Open:
    """A rank of a column that is searched for: its bracket, and how many values may lie inside."""

    column: str
    rank: int
    low: float
    high: float
    inside: float


def _double(x: float) -> str:
    return f"double('{'Infinity' if x == math.inf else '-Infinity' if x == -math.inf else repr(float(x))}')"


def _first_pass(df: DataFrame, columns: Sequence[str], also_count: Sequence[str]) -> tuple[dict[str, ColumnRanks], dict, dict]:
    """Sizes of the columns, points of their sketches, and nulls of the columns ``also_count``: one aggregation."""
    asked, given = [], []
    for i, c in enumerate(columns):
        v = f"CAST({quoted(c)} AS DOUBLE)"
        asked += [f"count({v}) AS n{i}", f"count_if({v} IS NULL) AS z{i}", f"count_if(isnan({v})) AS x{i}", f"{_sketch(v, TABLE_SKETCH)} AS s{i}"]
        given += [f"n{i}", f"z{i}", f"x{i}", f"CASE WHEN n{i} > x{i} THEN {_points(f's{i}', TABLE_POINTS)} END AS p{i}"]
    asked += [f"count_if({quoted(c)} IS NULL) AS y{i}" for i, c in enumerate(also_count)]
    given += [f"y{i}" for i in range(len(also_count))]
    row = df.agg(*map(F.expr, asked)).selectExpr(*given).first()
    sizes = {c: ColumnRanks(row[f"n{i}"], row[f"z{i}"]) for i, c in enumerate(columns)}
    numbers = {c: row[f"n{i}"] - row[f"x{i}"] for i, c in enumerate(columns)}
    points = {c: row[f"p{i}"] for i, c in enumerate(columns)}
    nulls = {c: row[f"y{i}"] for i, c in enumerate(also_count)}
    return sizes, {c: (numbers[c], points[c]) for c in columns}, nulls


def _narrowed(df: DataFrame, wanted: list[_Open]) -> tuple[list[tuple[_Open, float]], list[_Open]]:
    """One pass over the brackets: ranks whose value is proven, and the narrower brackets of the others."""
    spans = list(dict.fromkeys((w.column, w.low, w.high) for w in wanted))
    most = {span: max(w.inside for w in wanted if (w.column, w.low, w.high) == span) for span in spans}
    asked, given = [], []
    for i, (c, low, high) in enumerate(spans):
        v, lo, hi = f"CAST({quoted(c)} AS DOUBLE)", _double(low), _double(high)
        between = f"{v} > {lo} AND {v} < {hi}"
        inner = f"CASE WHEN {between} THEN {v} END"
        asked += [f"count_if({v} < {lo}) AS b{i}", f"count_if({v} = {lo}) AS l{i}", f"count_if({between}) AS m{i}", f"count_if({v} = {hi}) AS h{i}"]
        kept = most[c, low, high] <= KEPT
        asked.append(f"collect_list({inner}) AS v{i}" if kept else f"{_sketch(inner, TABLE_SKETCH)} AS v{i}")
        given += [f"b{i}", f"l{i}", f"m{i}", f"h{i}", f"v{i}" if kept else f"CASE WHEN m{i} > 0 THEN {_points(f'v{i}', TABLE_POINTS)} END AS v{i}"]
    row = df.agg(*map(F.expr, asked)).selectExpr(*given).first()
    proven, left = [], []
    listed = {}
    for w in wanted:
        span = w.column, w.low, w.high
        i = spans.index(span)
        below, at_low, inside, at_high = (row[f"{name}{i}"] for name in "blmh")
        upto = [below, below + at_low, below + at_low + inside, below + at_low + inside + (at_high if w.high > w.low else 0)]
        if w.rank <= upto[0]:
            left.append(_Open(w.column, w.rank, -math.inf, w.low, below))
        elif w.rank <= upto[1]:
            proven.append((w, w.low))
        elif w.rank > upto[2]:
            if w.rank <= upto[3]:
                proven.append((w, w.high))
            else:
                left.append(_Open(w.column, w.rank, w.high, math.inf, math.inf))
        elif most[span] <= KEPT:
            if span not in listed:
                listed[span] = sorted(row[f"v{i}"])
            proven.append((w, listed[span][w.rank - upto[1] - 1]))
        else:
            low, high = _bracket(row[f"v{i}"], w.rank - upto[1], inside, TABLE_REACH)
            width = inside * (2 * TABLE_REACH + 2 / TABLE_POINTS)
            left.append(_Open(w.column, w.rank, max(low, w.low), min(high, w.high), width))
    return proven, left


def table_ranks(
    df: DataFrame, ranks: Mapping[str, Callable[[int, int], Iterable[int]]], also_count: Sequence[str] = ()
) -> tuple[dict[str, ColumnRanks], dict[str, int]]:
    """For each column the values at the ranks (from 1 on) that its function names for a number of values and of nulls.

    Also the nulls of the columns ``also_count``. Two passes over the table, as a rule: sketches and counts, then proof. More follow only for
    brackets with over ``KEPT`` values, or which missed. The driver holds a few points and at most ``KEPT`` values for each rank.
    """
    found, shapes, nulls = _first_pass(df, list(ranks), also_count)
    wanted = []
    for c, column in found.items():
        numbers, points = shapes[c]
        for rank in dict.fromkeys(ranks[c](column.size, column.nulls)):
            if rank > numbers:
                column.values[rank] = math.nan
                continue
            low, high = _bracket(points, rank, numbers, TABLE_REACH)
            wanted.append(_Open(c, rank, low, high, numbers * (2 * TABLE_REACH + 2 / TABLE_POINTS)))
    while wanted:
        proven, wanted = _narrowed(df, wanted)
        for w, value in proven:
            found[w.column].values[w.rank] = value
    return found, nulls


def quantile_ranks(probs: Sequence[float], size: Column) -> list[tuple[Column, Column, Column]]:
    """(lower rank, upper rank, share of the way between) of each quantile among ``size`` values, interpolated linearly."""
    out = []
    for p in probs:
        place = (size - 1) * F.lit(p)
        out.append(((F.floor(place) + 1).cast("long"), (F.ceil(place) + 1).cast("long"), place - F.floor(place)))
    return out


def quantile_places(p: float, size: int) -> tuple[int, int, float]:
    """As ``quantile_ranks`` for one quantile, as plain numbers."""
    place = (size - 1) * p
    return math.floor(place) + 1, math.ceil(place) + 1, place - math.floor(place)


def sorted_ranks(probs: Sequence[float], size: int) -> list[int]:
    """Ranks that the quantiles of ``size`` values are made of; none without values."""
    return sorted({r for p in probs for r in quantile_places(p, size)[:2]}) if size else []


def quantile(values: Mapping[int, float], p: float, size: int) -> float:
    """Quantile from the values at its ranks, interpolated linearly."""
    low, high, share = quantile_places(p, size)
    return values[low] + (values[high] - values[low]) * share


def interpolated(values: Column, ranks: tuple[Column, Column, Column]) -> Column:
    """Quantile from a map of rank to value."""
    low, high, share = ranks
    return values[low] + (values[high] - values[low]) * share


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    exact: bool = True,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Quantiles of each column, linearly interpolated, nulls left out.

    Returns one row per group of ``keys`` (one row in all without keys); every column in ``columns`` becomes an array in the
    order of ``probs``, null where it has no values. Without keys the passes run when this is called (``table_ranks``); with keys
    the result is lazy. ``exact=False`` returns a sketch's answer in a single pass.
    """
    columns, probs, keys = list(columns), sorted(probs), list(keys)
    # Wide tables: SQL fragments are far quicker to build than column objects.
    values = [f"CAST({quoted(c)} AS DOUBLE)" for c in columns]
    if not exact:
        sketches = [F.percentile_approx(F.expr(v), probs, accuracy) for v in values]
        return df.groupBy(*keys).agg(*[q.alias(c) for q, c in zip(sketches, columns)])

    if not keys:
        figures, _ = table_ranks(df, {c: lambda size, nulls: sorted_ranks(probs, size) for c in columns})
        lists = {c: [quantile(figures[c].values, p, figures[c].size) for p in probs] if figures[c].size else None for c in columns}
        return df.sparkSession.range(1).select(*[F.lit(x).cast("array<double>").alias(c) for c, x in lists.items()])

    # One (measure, value) record per column, where the measure is the column's position.
    numbered = [str(i) for i in range(len(columns))]
    narrow = df.selectExpr(*[quoted(k) for k in keys], *[f"{v} AS `{i}`" for i, v in zip(numbered, values)])
    records = narrow.unpivot(keys, numbered, "measure", "value").withColumn("measure", F.col("measure").cast("int"))

    def ranks(size: Column, nulls: Column) -> Column:
        del nulls
        return F.array(*[r for low, high, _ in quantile_ranks(probs, size) for r in (low, high)])

    found = ranked_values(records, [*keys, "measure"], ranks)
    # Twice as many entries as there are quantiles, at most.
    by_rank = F.map_from_entries(F.collect_list(F.struct("rank", "value")))
    groups = found.groupBy(*keys, "measure", "size").agg(by_rank.alias("values"))
    answer = F.array(*[interpolated(F.col("values"), r) for r in quantile_ranks(probs, F.col("size"))])
    answers = groups.select(*keys, "measure", answer.alias("answer"))
    # At most one entry per column and group.
    by_measure = F.map_from_entries(F.collect_list(F.struct("measure", "answer")))
    listed = answers.groupBy(*keys).agg(by_measure.alias("_answers"))
    return listed.selectExpr(
        *[quoted(k) for k in keys], *[f"_answers[{at}] AS {quoted(c)}" for at, c in enumerate(columns)]
    )

