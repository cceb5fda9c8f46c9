"""Column functions shared by the operators. Everything here is a Spark expression."""

from farelens.functions.numeric import (
    between_bounds,
    clamp,
    clamp_load,
    null_if_nan,
    ratio,
    ratio_or_zero,
    rounded,
    rounded_mean,
)
from farelens.functions.text import (
    money_text,
    percent_text,
    preview_text,
    sign_class,
    strip_text,
    weekday_label,
    yes_no,
)

__all__ = [
    "between_bounds",
    "clamp",
    "clamp_load",
    "money_text",
    "null_if_nan",
    "percent_text",
    "preview_text",
    "ratio",
    "ratio_or_zero",
    "rounded",
    "rounded_mean",
    "sign_class",
    "strip_text",
    "weekday_label",
    "yes_no",
]
