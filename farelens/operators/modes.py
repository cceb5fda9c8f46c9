"""Exact most frequent values of text columns, also where nearly every value differs.

Counting every value moves every distinct value. Cells of the values' hashes are counted first: they are few, and a cell's count bounds
the count of each value in it. The values of the largest cells are then counted exactly, which gives a candidate; the bounds of all
other cells prove it or name the cells that may still hold the mode. Only these are counted further, by hash and not by value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.operators.quantiles import quoted

# Cells of a column, and the largest of them whose values are counted before the bounds are looked at.
CELLS, TOP_CELLS = 4096, 4
# Rows looked at to choose a way, and the share of them that must differ for a column to be searched by cells. Both ways give the same.
LOOK, DIFFERENT = 4096, 0.25


@dataclass
class _Search:
    """A column's cells as (bound of a value's count, cell), cells counted so far, and the best (count, value) in them."""

    cells: list[tuple[int, int]] = field(default_factory=list)
    counted: set[int] = field(default_factory=set)
    n: int = 0
    value: str | None = None

    def open(self) -> list[int]:
        """Cells that may hold a value as frequent as the best one; largest bound first."""
        return [cell for bound, cell in sorted(self.cells, key=lambda c: (-c[0], c[1])) if cell not in self.counted and bound >= max(self.n, 1)]

    def better(self, n: int, value: str) -> None:
        if (-n, value) < (-self.n, self.value or "") or not self.n:
            self.n, self.value = n, value


def _hash() -> Column:
    return F.xxhash64("value")


def _cell() -> Column:
    return F.pmod(_hash(), F.lit(CELLS)).cast("int")


def _values(df: DataFrame, cols: Sequence[str], numbers: Sequence[int]) -> DataFrame:
    """(name, value): the values of the columns with these numbers, one below the other."""
    names = [str(i) for i in numbers]
    chosen = df.selectExpr(*[f"CAST({quoted(cols[i])} AS STRING) AS `{i}`" for i in numbers])
    return chosen.unpivot([], names, "name", "value").filter(F.col("value").isNotNull()).withColumn("name", F.col("name").cast("int"))


def _in_cells(cells: dict[int, list[int]]) -> Column:
    """Whether a value lies in one of its column's cells."""
    wanted = F.lit(False)
    for i, listed in cells.items():
        wanted = wanted | ((F.col("name") == i) & (F.lit(True) if len(listed) == CELLS else _cell().isin(listed)))
    return wanted


def _best(values: DataFrame) -> list[tuple[int, int, str]]:
    """(name, count, value) of each column's most frequent value among ``values``, the smallest one on ties."""
    counts = values.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("best")
    return [(r["name"], -r["best"]["n"], r["best"]["value"]) for r in counts.groupBy("name").agg(least).collect()]


def _many_values(df: DataFrame, cols: Sequence[str]) -> list[int]:
    """Numbers of the columns whose first rows hold many different values."""
    rows = df.select(*[F.xxhash64(F.col(quoted(c))).alias(str(i)) for i, c in enumerate(cols)]).limit(LOOK).collect()
    return [i for i in range(len(cols)) if len({row[i] for row in rows}) > DIFFERENT * len(rows)]


def column_modes(df: DataFrame, cols: Sequence[str]) -> list[str | None]:
    """The most frequent value of each text column, the smallest one on ties, nulls left out; None without values.

    The passes run when this is called. Columns whose first rows hold few values are counted in one pass, in part before the shuffle. Of the
    others, two passes prove the mode where a column has a frequent value, however many values it holds: one
    counts ``CELLS`` cells a column, one the values of the ``TOP_CELLS`` largest. Where bounds leave other cells open, the 64-bit
    hashes in them are counted; the values of the hashes that reach the largest count are counted last. In a column whose values
    all differ the smallest one is the mode, and no value is moved. The driver holds the cells and one value of each column.
    """
    found = [_Search() for _ in cols]
    if not cols:
        return []
    many = _many_values(df, cols)
    few = [i for i in range(len(cols)) if i not in many]
    if few:
        for i, n, value in _best(_values(df, cols, few)):
            found[i].better(n, value)
    if many:
        _by_cells(df, cols, found, many)
    return [search.value for search in found]


def _by_cells(df: DataFrame, cols: Sequence[str], found: list[_Search], many: list[int]) -> None:
    """Find the modes of the columns with these numbers from cells and what their bounds leave open."""
    hashed = _values(df, cols, many).select("name", _hash().alias("h"), _cell().alias("cell"))
    cells = hashed.groupBy("name", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
    for r in cells.collect():
        # A cell of two hashes or more leaves each of its values one row less, at least.
        found[r["name"]].cells.append((r["n"] - (r["low"] != r["high"]), r["cell"]))
    top = {i: search.open()[:TOP_CELLS] for i, search in enumerate(found) if search.cells}
    if top:
        for i, n, value in _best(_values(df, cols, list(top)).filter(_in_cells(top))):
            found[i].better(n, value)
    for i, listed in top.items():
        found[i].counted.update(listed)
    left = {i: search.open() for i, search in enumerate(found) if search.open()}
    if left:
        _finish(df, cols, found, left)


def _finish(df: DataFrame, cols: Sequence[str], found: list[_Search], left: dict[int, list[int]]) -> None:
    """Settle the columns whose bounds leave cells open, by the counts of the hashes in these cells."""
    rows = _values(df, cols, list(left)).filter(_in_cells(left))
    counts = rows.groupBy("name", _hash().alias("h")).agg(F.count(F.lit(1)).alias("n"))
    # Two values of one hash only raise a count, so a hash's count bounds its values' too.
    most = {r["name"]: r["n"] for r in counts.groupBy("name").agg(F.max("n").alias("n")).collect()}
    single = [i for i, n in most.items() if n == 1 and found[i].n <= 1]
    if single:
        for r in _values(df, cols, single).groupBy("name").agg(F.min("value").alias("value")).collect():
            found[r["name"]].n, found[r["name"]].value = 1, r["value"]
    tied = {i: n for i, n in most.items() if i not in single and n >= found[i].n}
    if not tied:
        return
    reached = F.lit(False)
    for i, n in tied.items():
        reached = reached | ((F.col("name") == i) & (F.col("n") == n))
    chosen = counts.filter(reached).select("name", "h")
    wanted = rows.withColumn("h", _hash()).join(chosen, ["name", "h"], "left_semi").select("name", "value")
    short = set(tied)
    for i, n, value in _best(wanted):
        found[i].better(n, value)
        if n == tied[i]:
            short.discard(i)
    if short:
        # A hash reached its count with two values: count the values themselves.
        for i, n, value in _best(_values(df, cols, sorted(short))):
            found[i].n, found[i].value = n, value
