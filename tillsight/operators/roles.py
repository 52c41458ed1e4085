"""Column roles, read off a schema."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.functions.columns import named, rows_from

NUMERIC, CATEGORICAL, DATE, OTHER = "numeric", "categorical", "date", "other"
# A text column with one of these in its name is taken for a date.
DATE_NAME_PARTS = ("date", "time", "day", "month", "year")


@dataclass(frozen=True)
class Roles:
    """Columns by role, each list in schema order, with the schema they came from."""

    schema: T.StructType
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    date: tuple[str, ...]
    primary: str | None

    def type_of(self, name: str) -> T.DataType:
        return self.schema[name].dataType

    def role_of(self, name: str) -> str:
        for role, names in (
            (NUMERIC, self.numeric),
            (CATEGORICAL, self.categorical),
            (DATE, self.date),
        ):
            if name in names:
                return role
        return OTHER

    def with_primary(self, name: str) -> "Roles":
        """Another leading number than the first numeric column."""
        if name not in self.numeric:
            raise ValueError(f"{name!r} is not a numeric column")
        return replace(self, primary=name)


def role(field: T.StructField) -> str:
    if isinstance(field.dataType, T.NumericType):
        return NUMERIC
    if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    if isinstance(field.dataType, T.StringType):
        name = field.name.lower()
        return DATE if any(part in name for part in DATE_NAME_PARTS) else CATEGORICAL
    return OTHER


def classify(frame: DataFrame, primary: str | None = None) -> Roles:
    """Roles of the columns of a frame; needs its schema only and runs nothing."""
    by_role = {NUMERIC: [], CATEGORICAL: [], DATE: [], OTHER: []}
    for field in frame.schema.fields:
        by_role[role(field)].append(field.name)
    numeric = tuple(by_role[NUMERIC])
    roles = Roles(
        frame.schema,
        numeric,
        tuple(by_role[CATEGORICAL]),
        tuple(by_role[DATE]),
        numeric[0] if numeric else None,
    )
    return roles.with_primary(primary) if primary is not None else roles


def listed_roles(frame: DataFrame) -> DataFrame:
    """Role and type of every column, from the schema alone."""
    return frame.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), role(f)) for i, f in enumerate(frame.schema.fields)],
        "ordinal int, column string, type string, role string",
    )


def column_roles(frame: DataFrame) -> DataFrame:
    """Role, type and number of filled values of every column, in one aggregate."""
    filled = frame.agg(
        *[F.count(named(c)).alias(f"filled_{i}") for i, c in enumerate(frame.columns)]
    )
    return rows_from(
        filled,
        [
            {
                "ordinal": F.lit(i),
                "column": F.lit(field.name),
                "type": F.lit(field.dataType.simpleString()),
                "role": F.lit(role(field)),
                "filled": F.col(f"filled_{i}"),
            }
            for i, field in enumerate(frame.schema.fields)
        ],
    )
