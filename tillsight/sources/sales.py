"""The typed sales table: one row per order line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tillsight.functions import dates
from tillsight.functions.columns import named
from tillsight.sources.readers import scan_csv, scan_text_columns

# The column names of the sales contract.
ORDER_DATE = "Order Date"
AMOUNTS = ("Sales", "Profit", "Discount")


def type_sales(raw: DataFrame) -> DataFrame:
    """Parse the order date, derive its parts and cast the amounts, in one projection.

    Text that does not parse becomes null, in ANSI mode too.
    """
    day = dates.to_order_date(named(ORDER_DATE), raw.schema[ORDER_DATE].dataType)
    return raw.withColumns(
        {ORDER_DATE: day, **{name: named(name).try_cast("double") for name in AMOUNTS}}
    ).withColumns(
        {
            "Month": dates.month_name(named(ORDER_DATE)),
            "Year": F.year(named(ORDER_DATE)),
            "month_num": F.month(named(ORDER_DATE)),
        }
    )


def _rejects(raw: DataFrame) -> list[Column]:
    """Counts over raw rows: all, and those with text that is no date or no number.

    Blank and missing values are counted apart; both are null in the typed table. Rows without
    a date are those that month series leave out.
    """
    day = named(ORDER_DATE)
    typed = dates.to_order_date(day, raw.schema[ORDER_DATE].dataType)

    def blank(value: Column) -> Column:
        return value.isNull() | (F.trim(value.cast("string")) == "")

    counts = [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(blank(day)).alias("missing_dates"),
        F.count_if(~blank(day) & typed.isNull()).alias("bad_dates"),
        F.count_if(typed.isNull()).alias("undated_rows"),
    ]
    for name in AMOUNTS:
        value = named(name)
        bad = ~blank(value) & value.try_cast("double").isNull()
        counts.append(F.count_if(blank(value)).alias(f"missing_{name.lower()}"))
        counts.append(F.count_if(bad).alias(f"bad_{name.lower()}"))
    return counts


def rejects(raw: DataFrame) -> DataFrame:
    """One row of counts: what typing a raw sales table makes null, and how much was missing."""
    return raw.agg(*_rejects(raw))


def observed_sales(raw: DataFrame, observation: Observation) -> DataFrame:
    """The typed sales table, whose first action also counts what :func:`rejects` counts.

    The counts are in ``observation.get`` after that action; the rows are not read once more.
    """
    return type_sales(raw.observe(observation, *_rejects(raw)))


def read_sales(spark: SparkSession, path: str, schema=None, infer: bool = False) -> DataFrame:
    """CSV sales file, typed.

    Every column is read as text and the contract columns are typed, in one pass.
    ``infer=True`` infers the types of all other columns too, which reads the data once more.
    """
    if schema is None and not infer:
        return type_sales(scan_text_columns(spark, path))
    return type_sales(scan_csv(spark, path, schema))


def undated(sales: DataFrame) -> DataFrame:
    """How many rows have no order date; the month series leave them out."""
    return sales.agg(F.count_if(named(ORDER_DATE).isNull()).alias("undated_rows"))


def land_sales(sales: DataFrame, path: str) -> None:
    """Write typed sales as Parquet by year, so that a year filter prunes folders.

    ``rebalance`` evens out the written files: Spark splits a year that holds much of the
    data over several tasks and merges small ones.
    """
    sales.hint("rebalance", named("Year")).write.mode("errorifexists").partitionBy("Year").parquet(
        path
    )
