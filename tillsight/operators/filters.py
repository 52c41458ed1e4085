"""Filters: each is one predicate column, so Catalyst can push it to the scan."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.functions.columns import named

ALL = "All"
PARAMETER_PREFIX = "filter_"
# The columns searched for free text.
SEARCHED = ("Product Name", "Category", "Sub-Category")


def _chosen(value) -> bool:
    return value is not None and value != "" and value != ALL


def year_is(year: int | str, columns: list[str]) -> Column:
    """The order year, as a date range (sargable) and, where there is one, on ``Year``.

    A range on the date reaches the Parquet statistics; equality on ``Year`` prunes the
    folders of a table that was landed by year.
    """
    year = int(year)
    tests = []
    if "Order Date" in columns:
        day = named("Order Date")
        first, after = (F.lit(f"{y:04d}-01-01").cast("date") for y in (year, year + 1))
        tests.append((day >= first) & (day < after))
    if "Year" in columns:
        tests.append(named("Year") == year)
    if not tests:
        raise ValueError("a year filter needs the column 'Order Date' or 'Year'")
    return reduce(lambda a, b: a & b, tests)


def text_in(search: str, columns=SEARCHED) -> Column:
    """Literal, case-insensitive substring of any of the columns; null never matches."""
    needle = search.strip().lower()
    return reduce(lambda a, b: a | b, [F.lower(named(c)).contains(needle) for c in columns])


def filter_sales(
    sales: DataFrame,
    year: int | str | None = None,
    region: str | None = None,
    category: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """Sales rows that meet every given condition; None, "" and "All" set none."""
    tests = []
    if _chosen(year):
        tests.append(year_is(year, sales.columns))
    if _chosen(region):
        tests.append(named("Region") == region)
    if _chosen(category):
        tests.append(named("Category") == category)
    if search:
        tests.append(text_in(search))
    return reduce(lambda frame, test: frame.where(test), tests, sales)


def equals(schema: T.StructType, values: Mapping[str, str]) -> list[Column]:
    """One equality per known column; the text value is cast to the type of the column.

    Text that does not cast is null and so selects nothing. Unknown columns are ignored.
    """
    return [
        named(name) == F.lit(value).try_cast(schema[name].dataType)
        for name, value in values.items()
        if _chosen(value) and name in schema.fieldNames()
    ]


def filter_columns(frame: DataFrame, values: Mapping[str, str] | None) -> DataFrame:
    return reduce(lambda f, test: f.where(test), equals(frame.schema, values or {}), frame)


def parse_filters(parameters: Mapping[str, str]) -> dict[str, str]:
    """``filter_<column>=value`` request parameters as a column → value map."""
    return {
        key.removeprefix(PARAMETER_PREFIX): value
        for key, value in parameters.items()
        if key.startswith(PARAMETER_PREFIX) and _chosen(value)
    }
