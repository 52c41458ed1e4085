"""Date parsing, calendar parts and period keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The two text forms of an order date. One- and two-digit parts both parse.
ORDER_DATE_PATTERNS = ("M/d/yyyy", "M-d-yyyy")
ISO_PATTERN = "yyyy-M-d"


def parse_date(text: Column, patterns: tuple[str, ...] = ORDER_DATE_PATTERNS) -> Column:
    """First pattern that fits wins; text that fits none becomes null, also in ANSI mode."""
    trimmed = F.trim(text)
    return F.coalesce(*[F.try_to_date(trimmed, pattern) for pattern in patterns])


def to_order_date(column: Column, dtype: T.DataType) -> Column:
    """Date of a column that is text, a date or a timestamp."""
    if isinstance(dtype, T.StringType):
        return parse_date(column)
    return column.cast("date")


def month_name(day: Column) -> Column:
    return F.date_format(day, "MMM")


def month_label(day: Column) -> Column:
    return F.date_format(day, "MMM yyyy")


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def period_group(column: Column, dtype: T.DataType, raw_text_period: bool = False) -> Column:
    """What to group by so that each group is one period.

    Dates and timestamps group by the first day of the month, a four-byte key, and are
    turned into text only after the aggregation (:func:`period_text`). Text columns group
    by the period text itself: the month of a date that parses, else the first seven
    characters. ``raw_text_period`` takes the first seven characters in every case.
    """
    if isinstance(dtype, T.StringType):
        head = F.substring(column, 1, 7)
        if raw_text_period:
            return head
        parsed = parse_date(column, ORDER_DATE_PATTERNS + (ISO_PATTERN,))
        return F.coalesce(F.date_format(parsed, "yyyy-MM"), head)
    return month_start(column.cast("date"))


def period_text(group: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return group
    return F.date_format(group, "yyyy-MM")


def period_key(column: Column, dtype: T.DataType, raw_text_period: bool = False) -> Column:
    """``yyyy-MM`` per row, for use outside an aggregation."""
    return period_text(period_group(column, dtype, raw_text_period), dtype)


def period_month(period: Column, position: Column) -> Column:
    """Month number inside a ``yyyy-MM`` text; counts through the year where there is none.

    ``position`` is the zero-based place in the series.
    """
    in_shape = (F.length(period) >= 7) & (F.substring(period, 5, 1) == "-")
    number = F.when(in_shape, F.substring(period, 6, 2).try_cast("int"))
    return F.coalesce(number, (position % 12 + 1).cast("int"))
