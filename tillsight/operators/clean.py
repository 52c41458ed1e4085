"""Cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame


def drop_incomplete(frame: DataFrame) -> DataFrame:
    """Rows without any null."""
    return frame.na.drop("any")


def drop_repeats(frame: DataFrame) -> DataFrame:
    """One of each set of equal rows; copies collapse in their task before the shuffle."""
    return frame.dropDuplicates()


def clean(frame: DataFrame) -> DataFrame:
    return drop_repeats(drop_incomplete(frame))
