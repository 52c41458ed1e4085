"""Display texts against the same rules written in plain Python."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.functions import dates, numbers

random.seed(7)
AMOUNTS = [
    0.0, 0.004, 0.005, 0.125, 2.675, 5.0, 99.995, 999.0, 999.994, 999.996, 999.999, 1000.0, 1005.0,
    1234.5, 2500.0, 3500.0, 99_999.0, 99_999.99, 100_000.0, 125_000.0, 175_000.0, 145_000.0,
    250_000.0, 9_999_999.99, 10_000_000.0, 12_345_678.9, 3.1e9, 8.5e13,
] + [random.uniform(0, 10 ** random.randint(1, 10)) for _ in range(300)]
SIGNED = AMOUNTS + [-a for a in AMOUNTS if a]


def compact(x, prefix=""):
    size = abs(x)
    for limit, suffix in ((1e7, "Cr"), (1e5, "L"), (1e3, "K")):
        if size >= limit:
            text = f"{prefix}{round(size / limit, 2)}{suffix}"
            break
    else:
        text = f"{prefix}{round(size, 2)}"
    return "-" + text if x < 0 else text


def report(x):
    for limit, suffix in ((1e5, "L"), (1e3, "K")):
        if x >= limit:
            return f"₹{round(x / limit, 2)}{suffix}"
    return f"₹{round(x, 2)}"


def ties_up(x, decimals):
    step = Decimal(1).scaleb(-decimals)
    return str(Decimal(x).quantize(step, rounding=ROUND_HALF_UP))


def tick(x):
    if x >= 100_000:
        return f"₹{ties_up(x / 100_000, 1)}L"
    if x >= 1000:
        return f"₹{ties_up(x / 1000, 0)}K"
    return "₹" + (str(int(x)) if x == int(x) else repr(x))


def shown(spark, values, expression, dtype="double"):
    frame = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [row[0] for row in frame.select(expression(F.col("v"))).collect()]


def test_compact_number(spark):
    assert shown(spark, SIGNED, numbers.compact_number) == [compact(v) for v in SIGNED]


def test_compact_currency(spark):
    assert shown(spark, SIGNED, numbers.compact_currency) == [compact(v, "₹") for v in SIGNED]


def test_compact_report(spark):
    assert shown(spark, AMOUNTS, numbers.compact_report) == [report(v) for v in AMOUNTS]
    assert shown(spark, [-2000.0, -1.5], numbers.compact_report) == ["₹-2000.0", "₹-1.5"]


def test_compact_tick(spark):
    values = [v for v in AMOUNTS if v >= 1000] + [0.0, 5.0, 12.5, 950.0, -2000.0, -12_345_678.5]
    assert shown(spark, values, numbers.compact_tick) == [tick(v) for v in values]


def test_thousands(spark):
    texts = shown(spark, SIGNED, lambda c: numbers.thousands(c, T.DoubleType()))
    assert texts == [f"{v:,.2f}" for v in SIGNED]
    assert shown(spark, [1234567, -5], lambda c: numbers.thousands(c, T.LongType()), "bigint") == [
        "1,234,567",
        "-5",
    ]
    assert shown(spark, [None], lambda c: numbers.thousands(c, T.DoubleType())) == ["N/A"]
    assert shown(spark, [math.nan], lambda c: numbers.thousands(c, T.DoubleType())) == ["nan"]


@pytest.mark.parametrize(
    "value, text, kind", [(3.1, "+3.1%", "up"), (0.0, "+0.0%", "up"), (-12.0, "-12.0%", "down")]
)
def test_trend(spark, value, text, kind):
    assert shown(spark, [value], numbers.trend_text) == [text]
    assert shown(spark, [value], numbers.trend_class) == [kind]


def test_profit_class(spark):
    assert shown(spark, [0.0, -0.01], numbers.profit_class) == ["text-green", "text-danger"]


@pytest.mark.parametrize(
    "period, position, month",
    [("2024-07", 0, 7), ("2024-xx", 3, 4), ("07/2024", 13, 2), ("2024", 0, 1), ("2024-7-", 4, 5)],
)
def test_period_month(spark, period, position, month):
    frame = spark.createDataFrame([(period, position)], "p string, i int")
    assert frame.select(dates.period_month(F.col("p"), F.col("i"))).first()[0] == month


@pytest.mark.parametrize(
    "text, parsed, raw",
    [
        ("2024-03-05", "2024-03", "2024-03"),
        ("2024-03-05 10:00:00", "2024-03", "2024-03"),
        ("01/05/2024", "2024-01", "01/05/2"),
        ("1-5-2024", "2024-01", "1-5-202"),
        ("Spring", "Spring", "Spring"),
        (None, None, None),
    ],
)
def test_text_periods(spark, text, parsed, raw):
    frame = spark.createDataFrame([(text,)], "d string")
    d, dtype = F.col("d"), T.StringType()
    found = frame.select(dates.period_key(d, dtype), dates.period_key(d, dtype, True)).first()
    assert tuple(found) == (parsed, raw)
