"""Dataset profile: shape, schema, null counts and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.functions.columns import named, rows_from
from tillsight.functions.numbers import thousands, whole

PROFILED = (T.DoubleType, T.IntegerType, T.LongType, T.FloatType)
STATISTICS = ("count", "mean", "stddev", "min", "max")
NOT_AVAILABLE = "N/A"


def is_profiled(dtype: T.DataType, include_decimal: bool = False) -> bool:
    """Whether statistics are given: decimals, shorts and bytes are left out by default."""
    return isinstance(dtype, PROFILED + ((T.DecimalType,) if include_decimal else ()))


def _nulls(name: str) -> Column:
    return F.count_if(named(name).isNull())


def _measures(name: str) -> list[Column]:
    value = named(name).cast("double")
    return [
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("stddev"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]


def shape_of(counted: DataFrame, width: int) -> DataFrame:
    """The shape from a row count made elsewhere, in ``rows``."""
    text = F.concat(whole(F.col("rows")), F.lit(f" rows × {width} columns"))
    return counted.select("rows", F.lit(width).alias("columns"), text.alias("shape"))


def shape(frame: DataFrame) -> DataFrame:
    return shape_of(frame.agg(F.count(F.lit(1)).alias("rows")), len(frame.columns))


def null_counts(frame: DataFrame) -> DataFrame:
    counted = frame.agg(*[_nulls(c).alias(f"n{i}") for i, c in enumerate(frame.columns)])
    return rows_from(
        counted,
        [
            {"ordinal": F.lit(i), "column": F.lit(c), "null_count": F.col(f"n{i}")}
            for i, c in enumerate(frame.columns)
        ],
    )


def schema_listing(frame: DataFrame) -> DataFrame:
    """Name and type of every column with its number of nulls."""
    counted = frame.agg(*[_nulls(c).alias(f"n{i}") for i, c in enumerate(frame.columns)])
    return rows_from(
        counted,
        [
            {
                "ordinal": F.lit(i),
                "name": F.lit(f.name),
                "type": F.lit(str(f.dataType)),
                "null_count": F.col(f"n{i}"),
            }
            for i, f in enumerate(frame.schema.fields)
        ],
    )


def _profile(frame: DataFrame, fields: list[tuple[int, T.StructField]], measured: list[str]):
    """One aggregate over the frame, laid out as one row per given column."""
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, field in fields:
        aggregates.append(_nulls(field.name).alias(f"n{i}"))
        if field.name in measured:
            aggregates.append(F.struct(*_measures(field.name)).alias(f"s{i}"))
    rows = []
    for i, field in fields:
        row = {
            "ordinal": F.lit(i),
            "column": F.lit(field.name),
            "type": F.lit(str(field.dataType)),
            "rows": F.col("rows"),
            "null_count": F.col(f"n{i}"),
        }
        for statistic in STATISTICS:
            kind = "bigint" if statistic == "count" else "double"
            row[statistic] = (
                F.col(f"s{i}.{statistic}") if field.name in measured else F.lit(None).cast(kind)
            )
        rows.append(row)
    return rows_from(frame.agg(*aggregates), rows)


def _measured(frame: DataFrame, include_decimal: bool) -> list[str]:
    return [f.name for f in frame.schema.fields if is_profiled(f.dataType, include_decimal)]


def dataset_summary(frame: DataFrame, include_decimal: bool = False) -> DataFrame:
    """Type, row count, nulls and statistics of every column, in one pass."""
    return _profile(frame, list(enumerate(frame.schema.fields)), _measured(frame, include_decimal))


def describe_stats(frame: DataFrame, include_decimal: bool = False) -> DataFrame:
    """Typed statistics of the numeric columns.

    Without any numeric column every column is listed with empty statistics and the row
    count as its count.
    """
    measured = _measured(frame, include_decimal)
    fields = [(i, f) for i, f in enumerate(frame.schema.fields) if f.name in measured]
    if fields:
        profile = _profile(frame, fields, measured)
    else:
        profile = _profile(frame, list(enumerate(frame.schema.fields)), []).withColumn(
            "count", F.col("rows")
        )
    return profile.select("ordinal", "column", *STATISTICS, "null_count")


def describe_text(frame: DataFrame, include_decimal: bool = False) -> DataFrame:
    """The statistics as display texts."""
    empty = not _measured(frame, include_decimal)
    return _texts(describe_stats(frame, include_decimal), empty)


def _texts(statistics: DataFrame, empty: bool) -> DataFrame:
    shown = [
        (F.lit(NOT_AVAILABLE) if empty else thousands(F.col(s), T.DoubleType())).alias(s)
        for s in STATISTICS[1:]
    ]
    return statistics.select(
        "ordinal", "column", F.col("count").cast("string").alias("count"), *shown, "null_count"
    )


def sections_of(columns: DataFrame, frame: DataFrame) -> dict[str, DataFrame]:
    """Shape, schema and display texts from a :func:`dataset_summary` of the frame."""
    measured = _measured(frame, False)
    if measured:
        statistics = columns.where(F.col("column").isin(measured))
    else:
        statistics = columns.withColumn("count", F.col("rows"))
    counted = columns.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("rows"))
    return {
        "shape": shape_of(counted, len(frame.columns)),
        "schema": columns.select("ordinal", F.col("column").alias("name"), "type", "null_count"),
        "statistics": _texts(statistics, not measured),
        "columns": columns,
    }
