"""Scans: headed CSV files and Parquet tables, one file or a landing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    sampling_ratio: float = 1.0,
) -> DataFrame:
    """Headed CSV. In a folder only ``*.csv`` files are read.

    Without a schema the types are inferred, which reads the data once more: pass a
    schema for large inputs, or a ``sampling_ratio`` below one.
    """
    reader = spark.read.option("header", True).option("pathGlobFilter", "*.csv")
    if schema is not None:
        return reader.schema(schema).option("enforceSchema", False).csv(path)
    return reader.option("inferSchema", True).option("samplingRatio", sampling_ratio).csv(path)


def scan_text_columns(spark: SparkSession, path: str) -> DataFrame:
    """Headed CSV with every column as text: only the header line is read up front."""
    return spark.read.option("header", True).option("pathGlobFilter", "*.csv").csv(path)


def scan(spark: SparkSession, path: str, form: str | None = None, **options) -> DataFrame:
    """CSV or Parquet; without ``form`` they are told apart by the ending of the path."""
    if form == "parquet" or (form is None and path.rstrip("/").endswith(".parquet")):
        return spark.read.parquet(path)
    return scan_csv(spark, path, **options)
