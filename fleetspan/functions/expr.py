"""Column builders used across the operators."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {
    ">": operator.gt,
    ">=": operator.ge,
    "<": operator.lt,
    "<=": operator.le,
    "==": operator.eq,
}
_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def at(moment: datetime) -> Column:
    """A zone-free timestamp literal; folds to a constant, so filters on it reach the scan."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def before(as_of: datetime, **delta: float) -> Column:
    """The literal ``as_of - delta``."""
    return at(as_of - timedelta(**delta))


def band(value: Column, ladder: Sequence[tuple[str, object, str]], default: str) -> Column:
    """First matching rung wins; a NULL value matches none and takes the default."""
    out = None
    for op, threshold, label in ladder:
        hit = _COMPARE[op](value, F.lit(threshold))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def first_match(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """CASE over (condition, label) pairs."""
    out = None
    for condition, label in rules:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(default)


def decode(col: Column, mapping: dict, default: str | None = None) -> Column:
    """Code to label; unknown codes take the default (NULL when none is given)."""
    out = None
    for code, label in mapping.items():
        out = F.when(col == code, label) if out is None else out.when(col == code, label)
    return out.otherwise(default)


def any_like(col: Column, patterns: Sequence[str], ignore_case: bool = False) -> Column:
    """TRUE where any LIKE pattern matches."""
    out = F.lit(False)
    for pattern in patterns:
        out = out | (col.ilike(pattern) if ignore_case else col.like(pattern))
    return out


def boundary_diff(unit: str, start: Column, end: Column) -> Column:
    """Number of unit boundaries crossed between two timestamps (not whole units elapsed)."""
    gap = F.unix_timestamp(F.date_trunc(unit, end)) - F.unix_timestamp(F.date_trunc(unit, start))
    return F.floor(gap / _UNIT_SECONDS[unit])


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds, truncated to whole seconds of each end."""
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def trunc_ts(unit: str, col: Column) -> Column:
    """date_trunc that stays zone-free."""
    return F.date_trunc(unit, col).cast("timestamp_ntz")


def ratio(num: Column, den: Column, scale: float = 1.0, digits: int = 2) -> Column:
    """num * scale / den as DOUBLE, NULL on a zero denominator."""
    return F.round(num.cast("double") * scale / F.nullif(den.cast("double"), F.lit(0.0)), digits)


def truncated_div(num: Column, den: Column) -> Column:
    """Integer division of whole numbers that drops the fraction, exact beyond 2^53; NULL on a zero denominator."""
    return F.call_function("div", num.cast("bigint"), F.nullif(den.cast("bigint"), F.lit(0).cast("bigint")))


def not_in(col: Column, names: Sequence[str]) -> Column:
    """Whether a value is none of the names; a NULL is none of them."""
    return ~F.coalesce(col.isin(list(names)), F.lit(False))


def not_like(col: Column, pattern: str) -> Column:
    """Whether a text does not match; a NULL does not."""
    return ~F.coalesce(col.like(pattern), F.lit(False))


def total(col: Column) -> Column:
    return F.sum(col).cast("bigint")


def count_if(condition: Column) -> Column:
    """Number of rows where the condition holds; 0 when there are none."""
    return F.count(F.when(condition, 1))


def ordered_names(order: Column, name: Column) -> Column:
    """Array of names in the given order. Only for groups bounded by design (index key columns)."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("k"), name.alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


# Binary size units, largest first.
BYTE_UNITS = [
    (1099511627776, "TB"),
    (1073741824, "GB"),
    (1048576, "MB"),
    (1024, "KB"),
]


def format_bytes(col: Column, digits: int | None = 2) -> Column:
    """Human-readable size. ``digits=None`` keeps the full double instead of rounding."""
    out = None
    for size, unit in BYTE_UNITS:
        amount = col.cast("double") / size
        if digits is not None:
            amount = F.format_string(f"%.{digits}f", F.round(amount, digits))
        text = F.concat(amount.cast("string"), F.lit(f" {unit}"))
        out = F.when(col >= size, text) if out is None else out.when(col >= size, text)
    return out.otherwise(F.concat(col.cast("string"), F.lit(" bytes")))


def format_rate_mb(col: Column) -> Column:
    """Daily growth text: GB above 1024 MB a day, else MB."""
    two = lambda c: F.format_string("%.2f", F.round(c, 2))
    return F.when(col > 1024, F.concat(two(col / 1024), F.lit(" GB/day"))).otherwise(
        F.concat(two(col), F.lit(" MB/day"))
    )


def fill_template(template: Column, *values: Column) -> Column:
    """Put the values in place of ``{0}``, ``{1}``, ...; a missing value leaves an empty place."""
    for i, value in enumerate(values):
        template = F.replace(template, F.lit(f"{{{i}}}"), F.coalesce(value, F.lit("")))
    return template


def type_text(base: Column, length: Column, precision: Column, scale: Column) -> Column:
    """``varchar(n)`` / ``decimal(p,s)`` / bare type name."""
    return (
        F.when(length.isNotNull(), F.concat(base, F.lit("("), length.cast("string"), F.lit(")")))
        .when(
            precision.isNotNull(),
            F.concat(base, F.lit("("), precision.cast("string"), F.lit(","), scale.cast("string"), F.lit(")")),
        )
        .otherwise(base)
    )
