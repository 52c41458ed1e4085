"""Small helpers for naming and laying out columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """Column by its exact name; back-ticks keep dots and blanks in names literal."""
    return F.col("`" + name.replace("`", "``") + "`")


def rows_from(frame: DataFrame, rows: Sequence[dict[str, Column]]) -> DataFrame:
    """Lay the columns of a one-row frame out as one row per entry of ``rows``."""
    structs = [F.struct(*[value.alias(key) for key, value in row.items()]) for row in rows]
    return frame.select(F.inline(F.array(*structs)))
