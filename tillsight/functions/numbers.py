"""Number and amount texts, all from built-in expressions.

``format_number`` rounds the exact binary value half-to-even, which is how the texts of
the dashboards are rounded; ``round`` would go by the shortest decimal text instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Indian units, largest first, and the currency sign.
CRORE = (10_000_000.0, "Cr")
LAKH = (100_000.0, "L")
THOUSAND = (1_000.0, "K")
UNITS = (CRORE, LAKH, THOUSAND)
REPORT_UNITS = (LAKH, THOUSAND)
RUPEE = "₹"


def fixed(value: Column, decimals: int) -> Column:
    """Fixed number of decimals, no thousands separators."""
    return F.translate(F.format_number(value, decimals), ",", "")


def short_decimal(value: Column) -> Column:
    """At most two decimals and at least one: 1.5, 2.0, 3.14."""
    return F.regexp_replace(fixed(value, 2), "0$", "")


def _scaled(size: Column, shown: Column, units, prefix: str) -> Column:
    text = None
    for limit, suffix in units:
        part = F.concat(F.lit(prefix), short_decimal(shown / limit), F.lit(suffix))
        text = F.when(size >= limit, part) if text is None else text.when(size >= limit, part)
    return text.otherwise(F.concat(F.lit(prefix), short_decimal(shown)))


def compact_number(value: Column, prefix: str = "") -> Column:
    """1234.5 → 1.23K, 250000 → 2.5L, 31000000 → 3.1Cr; the sign stays in front."""
    size = F.abs(value)
    text = _scaled(size, size, UNITS, prefix)
    return F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text)


def compact_currency(value: Column) -> Column:
    return compact_number(value, RUPEE)


def compact_report(value: Column) -> Column:
    """The report's shorter scale: lakh and thousand only, negatives never scaled."""
    return _scaled(value, value, REPORT_UNITS, RUPEE)


def _ties_up(value: Column, decimals: int) -> Column:
    """Fixed decimals with exact halves rounded up instead of to even."""
    part = value - F.floor(value)
    if decimals == 0:
        nudged = F.when(part == 0.5, value + 0.25).otherwise(value)
    else:  # with one decimal the only exact halves are quarters
        nudged = F.when((part == 0.25) | (part == 0.75), value + 0.01).otherwise(value)
    return fixed(nudged, decimals)


def compact_tick(value: Column) -> Column:
    """Axis label: lakh with one decimal, thousand with none, small values as they are."""
    rest = F.when(
        F.abs(value) < 1e7, F.regexp_replace(value.cast("string"), r"\.0$", "")
    ).otherwise(F.regexp_replace(F.regexp_replace(fixed(value, 6), "0+$", ""), r"\.$", ""))
    return (
        F.when(
            value >= LAKH[0],
            F.concat(F.lit(RUPEE), _ties_up(value / LAKH[0], 1), F.lit(LAKH[1])),
        )
        .when(
            value >= THOUSAND[0],
            F.concat(F.lit(RUPEE), _ties_up(value / THOUSAND[0], 0), F.lit(THOUSAND[1])),
        )
        .otherwise(F.concat(F.lit(RUPEE), rest))
    )


def thousands(value: Column, dtype: T.DataType) -> Column:
    """Thousands separators; two decimals for floating point, none for integers."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = F.when(F.isnan(value), F.lit("nan")).otherwise(F.format_number(value, 2))
    elif isinstance(dtype, T.IntegralType) or (
        isinstance(dtype, T.DecimalType) and dtype.scale == 0
    ):
        text = F.format_number(value, 0)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("N/A"))


def whole(value: Column) -> Column:
    """Count with thousands separators."""
    return F.format_number(value, 0)


def percent_text(value: Column) -> Column:
    """One-decimal percentage text, e.g. 4.5%."""
    return F.concat(fixed(value, 1), F.lit("%"))


def trend_text(value: Column) -> Column:
    """Signed percentage: +3.1%, -0.4%."""
    sign = F.when(value >= 0, F.lit("+")).otherwise(F.lit(""))
    return F.concat(sign, fixed(value + F.lit(0.0), 1), F.lit("%"))


# Class names shown for rising/falling and for profit/loss.
UP, DOWN = "up", "down"
GAIN, LOSS = "text-green", "text-danger"


def trend_class(value: Column) -> Column:
    return F.when(value >= 0, F.lit(UP)).otherwise(F.lit(DOWN))


def profit_class(value: Column) -> Column:
    return F.when(value >= 0, F.lit(GAIN)).otherwise(F.lit(LOSS))
