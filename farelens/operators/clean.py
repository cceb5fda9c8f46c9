"""Column resolution and cleaning.

The order of the steps is part of the result: dates, filling, aliases, outlier bounds, route name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farelens.fixed_values import IQR_COLUMNS, IQR_REACH, REQUIRED_COLUMNS
from farelens.functions import between_bounds
from farelens.operators.modes import column_modes
from farelens.operators.quantiles import ColumnRanks, exact_quantiles, quantile, quantile_places, quoted, sorted_ranks, table_ranks
from farelens.sources.flights import nan_to_null
from farelens.sources.shared import new_folder

# target column -> column it is copied from when the target is missing
_ALIASES = {
    "profit_margin": "profit_rate",
    "ticket_price": "avg_ticket_price",
    "sold_seats": "booked_seats",
}
_CALENDAR = ("month", "day_of_week")


def resolve_date(df: DataFrame, lenient: bool = False) -> DataFrame:
    """Column ``date`` from ``flight_date``, else from ``date`` itself; unchanged without either.

    A text that is no date raises; with ``lenient`` it becomes null.
    """
    source = next((c for c in ("flight_date", "date") if c in df.columns), None)
    if source is None:
        return df
    if isinstance(df.schema[source].dataType, T.StringType):
        parsed = F.try_to_timestamp(F.col(source)) if lenient else F.col(source).cast("timestamp")
        return df.withColumn("date", parsed.cast("date"))
    return df.withColumn("date", F.col(source).cast("date"))


def add_calendar(df: DataFrame) -> DataFrame:
    """Month 1..12 and weekday 0..6 with Monday = 0; an incoming 1..7 weekday is overwritten."""
    if "date" not in df.columns:
        return df
    return df.withColumns({"month": F.month("date"), "day_of_week": F.weekday("date")})


def _is_missing(field: T.StructField) -> Column:
    """Null, or in a floating column not a number."""
    col = F.col(quoted(field.name))
    return col.isNull() | F.isnan(col) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else col.isNull()


def missing_counts(df: DataFrame) -> DataFrame:
    """Columns that hold nulls or NaN, with the number of these."""
    counts = df.agg(*[F.count_if(_is_missing(f)).alias(f.name) for f in df.schema.fields])
    return counts.unpivot([], df.columns, "column_name", "missing").filter(F.col("missing") > 0)


def columns_with_gaps(df: DataFrame) -> list[str]:
    """Names of the columns that hold nulls or NaN; runs one count over the table, whose result is one figure per column."""
    return [row["column_name"] for row in missing_counts(df).collect()]


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns; booleans and dates are not numbers here."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _filled_type(kind: T.DataType) -> str:
    """Type of a numeric column after filling: a median may end in one half, and a LONG does not fit a double."""
    return "decimal(20,1)" if isinstance(kind, T.LongType) else kind.simpleString() if isinstance(kind, T.DecimalType) else "double"


def _filled(df: DataFrame, name: str, value: Column) -> Column:
    kind = "int" if name in _CALENDAR else _filled_type(df.schema[name].dataType)
    return F.coalesce(F.col(quoted(name)).cast(kind), value.cast(kind))


def _in_filled(column: ColumnRanks, place: int, gaps: int, median: float) -> float:
    """Value at a place (from 0 on) of a sorted column whose gaps became the median, from the ranks of the column itself.

    The copies of the median stand after the values up to the middle.
    """
    before = (column.size - 1) // 2 + 1
    if place < before:
        return column.values[place + 1]
    return median if place < before + gaps else column.values[place - gaps + 1]


def _original_rank(place: int, size: int, gaps: int) -> int:
    """Rank to look up for a place of the filled column; the middle for a copy of the median."""
    before = (size - 1) // 2 + 1
    return place + 1 if place < before else before if place < before + gaps else place - gaps + 1


_QUARTILES = (0.25, 0.75)


def _wanted_ranks(filled: bool, capped: bool):
    """Ranks of a column for its median and, after filling, its quartiles; a column that stays as it is needs none."""

    def ranks(size: int, nulls: int) -> list[int]:
        gaps = nulls if filled else 0
        if not size or not (gaps or capped):
            return []
        wanted = sorted_ranks([0.5], size)
        for p in _QUARTILES if capped else ():
            wanted += [_original_rank(place - 1, size, gaps) for place in quantile_places(p, size + gaps)[:2]]
        return wanted

    return ranks


def _figures_of(column: ColumnRanks, filled: bool, capped: bool) -> dict[str, float | None]:
    """Median, and bounds of the column after its gaps are filled with it; none of a column without values."""
    if not column.values:
        return {"median": None, "low": None, "high": None}
    gaps, median = column.nulls if filled else 0, quantile(column.values, 0.5, column.size)
    out = {"median": median, "low": None, "high": None}
    if capped:
        quarters = []
        for p in _QUARTILES:
            low, high, share = quantile_places(p, column.size + gaps)
            below, above = (_in_filled(column, place - 1, gaps, median) for place in (low, high))
            quarters.append(below + (above - below) * share)
        reach = (quarters[1] - quarters[0]) * IQR_REACH
        out |= {"low": quarters[0] - reach, "high": quarters[1] + reach}
    return out


def _number(x: float | None) -> Column:
    return F.lit(x).cast("double")


def _sketched_figures(df: DataFrame, gaps: Sequence[str], capped: Sequence[str]) -> Column:
    """The same from sketches, in one pass; quartiles are those before filling."""
    names = list(dict.fromkeys([*gaps, *capped]))
    quantiles = exact_quantiles(df, names, [0.25, 0.5, 0.75], exact=False)
    entries = []
    for c in names:
        q = F.col(quoted(c))
        reach = (q[2] - q[0]) * IQR_REACH
        figures = F.struct(q[1].alias("median"), (q[0] - reach).alias("low"), (q[2] + reach).alias("high"))
        entries += [F.lit(c), figures]
    return quantiles.select(F.create_map(*entries).alias("figures")).scalar()


def _fill_and_cap(df: DataFrame, gaps: Sequence[str] | None, capped: Sequence[str], exact: bool, only: Sequence[str] | None = None) -> DataFrame:
    """Fill the columns in ``gaps``, move the columns in ``capped`` into their bounds, leave all others alone.

    ``gaps`` None: columns with gaps, among ``only`` if given, are those with nulls in the pass that takes the sketches.
    """
    open_gaps = gaps is None
    able = [c for c in df.columns if (only is None or c in only) and (open_gaps or c in gaps)]
    numeric = [c for c in numeric_columns(df) if c in able]
    texts = [c for c in text_columns(df) if c in able]
    capped = [c for c in capped if c in df.columns]
    names = list(dict.fromkeys([*numeric, *capped]))
    found, changed, figures = {}, {}, {}
    if not exact:
        if open_gaps:
            holding = columns_with_gaps(df.select(*map(quoted, able)))
            numeric, texts = [c for c in numeric if c in holding], [c for c in texts if c in holding]
            names = list(dict.fromkeys([*numeric, *capped]))
        if names:
            found["_figures"] = _sketched_figures(df, numeric, capped)
            figures = {c: {k: F.col("_figures")[c][k] for k in ("median", "low", "high")} for c in names}
    elif names or (texts and open_gaps):
        wanted = {c: _wanted_ranks(c in numeric, c in capped) for c in names}
        columns, empty = table_ranks(df, wanted, texts if open_gaps else ())
        if open_gaps:
            numeric, texts = [c for c in numeric if columns[c].nulls], [c for c in texts if empty[c]]
        plain = {c: _figures_of(columns[c], c in numeric, c in capped) for c in dict.fromkeys([*numeric, *capped])}
        figures = {c: {k: _number(x) for k, x in of_column.items()} for c, of_column in plain.items()}
    modes = column_modes(df, texts)
    for c in dict.fromkeys([*numeric, *capped]):
        value = _filled(df, c, figures[c]["median"]) if c in numeric else F.col(quoted(c))
        changed[c] = between_bounds(value, figures[c]["low"], figures[c]["high"]) if c in capped else value
    changed.update({c: F.coalesce(F.col(quoted(c)), F.lit(mode)) for c, mode in zip(texts, modes, strict=True) if mode is not None})
    return df.withColumns(found).withColumns(changed).drop(*found) if found or changed else df


def fill_numeric_median(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Fill nulls and NaN of numeric columns with the column's median.

    Only columns with gaps change. As a median may lie between two integers, a filled LONG becomes DECIMAL(20,1) and other
    integers double; month and weekday stay whole. Without ``cols`` the gaps are counted in the pass that takes the sketches. The
    medians are found when this is called (see ``table_ranks``).
    """
    wanted = numeric_columns(df)
    return _fill_and_cap(nan_to_null(df), None if cols is None else [c for c in wanted if c in cols], (), exact, wanted)


def fill_categorical_mode(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Fill nulls of text columns with the most frequent value, the smallest one on ties.

    The modes are found when this is called (see ``column_modes``). Without ``cols`` the columns with gaps are found first, which runs one pass.
    """
    wanted = text_columns(df)
    gaps = columns_with_gaps(df.select(*map(quoted, wanted))) if cols is None else [c for c in wanted if c in cols]
    return _fill_and_cap(df, gaps, (), True)


def fill_missing(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Both fillings in one step: numeric columns by median, text columns by mode. Other kinds of columns are left alone."""
    return _fill_and_cap(nan_to_null(df), cols, (), exact)


def _copied(df: DataFrame) -> dict[str, str]:
    """Analytic names that are missing, with the operational column each is copied from."""
    have = set(df.columns)
    return {target: source for target, source in _ALIASES.items() if target not in have and source in have}


def resolve_aliases(df: DataFrame) -> DataFrame:
    """Copy operational columns to their analytic names where those are missing; the source columns stay.

    A table without ``route_name`` gets it from its two cities, else from ``route``.
    """
    copies = _copied(df)
    named = ensure_route_name(df.withColumns({target: F.col(source) for target, source in copies.items()}) if copies else df)
    if "route_name" not in named.columns and "route" in named.columns:
        named = named.withColumn("route_name", F.col("route"))
    return named


def _iqr_bounds(df: DataFrame, cols: Sequence[str], exact: bool) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """The table, and (low, high) for the whole of it in the order of ``cols``: figures, or with sketches a scalar that comes along."""
    if exact:
        columns, _ = table_ranks(df.select(*map(quoted, cols)), {c: lambda size, nulls: sorted_ranks(_QUARTILES, size) for c in cols})
        bounds = []
        for c in cols:
            column = columns[c]
            low, high = (quantile(column.values, p, column.size) if column.size else None for p in _QUARTILES)
            reach = (high - low) * IQR_REACH if column.size else None
            bounds.append((_number(low - reach), _number(high + reach)) if column.size else (_number(None), _number(None)))
        return df, bounds
    quartiles = exact_quantiles(df.select(*cols), cols, [0.25, 0.75], exact=False)
    spans = F.transform(
        F.array(*cols),
        lambda q: F.struct(
            (q[0] - (q[1] - q[0]) * IQR_REACH).alias("low"),
            (q[1] + (q[1] - q[0]) * IQR_REACH).alias("high"),
        ),
    )
    marked = df.withColumn("_bounds", quartiles.select(spans.alias("bounds")).scalar())
    return marked, [(F.col("_bounds")[i]["low"], F.col("_bounds")[i]["high"]) for i in range(len(cols))]


def iqr_outlier_counts(
    df: DataFrame, cols: Sequence[str] = IQR_COLUMNS, exact: bool = True
) -> DataFrame:
    """Per column: bounds at 1.5 interquartile ranges and the number of values strictly outside."""
    cols = [c for c in cols if c in df.columns]
    marked, bounds = _iqr_bounds(df.select(*cols), cols, exact)
    stats = []
    for c, (low, high) in zip(cols, bounds, strict=True):
        stats.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.max(low).alias("lower_bound"),
                F.max(high).alias("upper_bound"),
                F.count_if((F.col(c) < low) | (F.col(c) > high)).alias("outliers"),
            ).alias(c)
        )
    return marked.agg(*stats).select(F.inline(F.array(*cols)))


def cap_iqr(df: DataFrame, cols: Sequence[str] = IQR_COLUMNS, exact: bool = True) -> DataFrame:
    """Move values outside the interquartile bounds onto the bounds; one pair of bounds per column."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    marked, bounds = _iqr_bounds(df, cols, exact)
    return marked.withColumns({c: between_bounds(F.col(c), *span) for c, span in zip(cols, bounds, strict=True)}).drop("_bounds")


def ensure_route_name(df: DataFrame) -> DataFrame:
    """``departure-arrival`` as the route name where that column is missing; null if a part is."""
    have = set(df.columns)
    if "route_name" in have or not {"departure_city", "arrival_city"} <= have:
        return df
    return df.withColumn("route_name", F.concat("departure_city", F.lit("-"), "arrival_city"))


def split_route(df: DataFrame) -> DataFrame:
    """Origin and destination from the route name."""
    return df.withColumns(
        {
            "origin": F.split_part(F.col("route_name"), F.lit("-"), F.lit(1)),
            "destination": F.split_part(F.col("route_name"), F.lit("-"), F.lit(2)),
        }
    )


def require_columns(df: DataFrame, names: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """The table itself; raises while the plan is built when a column is missing."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_calendar(df: DataFrame) -> DataFrame:
    """Date, month and weekday: the columns that cleaning adds before it fills gaps."""
    return add_calendar(resolve_date(df))


def preprocess(df: DataFrame, fill: Sequence[str] | None = None, exact: bool = True, folder: str | None = None) -> DataFrame:
    """The whole cleaning sequence: dates, filling, aliases, bounds, route name.

    ``fill`` names the columns to fill; without it all columns with gaps are. With ``folder``, which all executors must share, the dated
    input is written there once, gaps are counted on the way (observed metrics), and all passes read that columnar copy: the input
    itself is read once. Without it the gaps come from the pass that takes the sketches. Two passes find medians and bounds
    together when this is called, two more prove the modes of text columns with gaps, and the last writes the result.
    """
    dated = with_calendar(nan_to_null(df))
    copies = _copied(dated)
    # A copy has the gaps of its source, so that both are filled and bounded in one search.
    copied = dated.withColumns({target: F.col(source) for target, source in copies.items()}) if copies else dated
    gaps = None if fill is None else [*fill, *[target for target, source in copies.items() if source in fill]]
    if folder is not None:
        seen = Observation()
        path = new_folder(folder, "dated")
        holes = [F.count_if(_is_missing(f)).alias(str(i)) for i, f in enumerate(copied.schema.fields)]
        copied.observe(seen, *holes).write.parquet(path)
        counted = seen.get
        copied = df.sparkSession.read.schema(copied.schema).parquet(path)
        gaps = [c for i, c in enumerate(copied.columns) if counted[str(i)]] if gaps is None else gaps
    return require_columns(resolve_aliases(_fill_and_cap(copied, gaps, IQR_COLUMNS, exact)))
