"""Text and label helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from farelens.fixed_values import WEEKDAY_NAMES, WHITESPACE
from farelens.functions.numeric import rounded_mean


def weekday_label(iso_dow: Column) -> Column:
    """Weekday name of 1..7, Monday first; null outside that range."""
    names = F.array(*[F.lit(name) for name in WEEKDAY_NAMES])
    return F.when(iso_dow.between(1, 7), F.element_at(names, iso_dow.cast("int")))


def preview_text(col: Column, n: int) -> Column:
    """First ``n`` characters, followed by three dots when something was cut."""
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


def strip_text(col: Column) -> Column:
    """Remove leading and trailing whitespace, line breaks and wide spaces included."""
    return F.btrim(col, F.lit(WHITESPACE))


def percent_text(col: Column, digits: int = 2) -> Column:
    """Fraction shown as percent, e.g. 0.1234 -> ``12.34%``."""
    return F.format_string(f"%.{digits}f%%", rounded_mean(col * F.lit(100.0), digits))


def money_text(col: Column, digits: int = 2) -> Column:
    """Amount with a fixed number of decimals and no grouping."""
    return F.format_string(f"%.{digits}f", rounded_mean(col, digits))


def sign_class(col: Column) -> Column:
    """``positive`` for values above zero, else ``negative``."""
    return F.when(col > 0, F.lit("positive")).otherwise(F.lit("negative"))


def yes_no(flag: Column) -> Column:
    return F.when(flag, F.lit("是")).otherwise(F.lit("否"))
