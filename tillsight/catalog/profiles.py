"""Dataset profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.catalog.registry import Catalog, table
from tillsight.operators import profile

CATALOG = Catalog()

_LINEITEM = [
    ("l_orderkey", "LongType()"),
    ("l_partkey", "LongType()"),
    ("l_suppkey", "LongType()"),
    ("l_linenumber", "IntegerType()"),
    ("l_quantity", "DoubleType()"),
    ("l_extendedprice", "DoubleType()"),
    ("l_discount", "DoubleType()"),
    ("l_tax", "DoubleType()"),
    ("l_returnflag", "StringType()"),
    ("l_linestatus", "StringType()"),
    ("l_shipdate", "TimestampNTZType()"),
]
_EVENTS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def _nulls(name: str) -> str:
    return f"count(*) - count({name})"


def _statistics(name: str) -> str:
    return (
        f"count({name}) AS count, round(avg({name}), 6) AS mean, "
        f"round(stddev_samp({name}), 6) AS stddev, CAST(min({name}) AS DOUBLE) AS min, "
        f"CAST(max({name}) AS DOUBLE) AS max"
    )


_NO_STATISTICS = (
    "CAST(NULL AS BIGINT) AS count, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS stddev, "
    "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max"
)


def _numeric(kind: str) -> bool:
    return kind in ("LongType()", "IntegerType()", "DoubleType()")


def _rounded(frame):
    return frame.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@CATALOG.query(
    """SELECT count(*) AS rows, CAST(11 AS INTEGER) AS columns,
    format('{:,}', count(*)) || ' rows × 11 columns' AS shape FROM lineitem"""
)
def shape(spark, root):
    return profile.shape(table(spark, root, "lineitem"))


@CATALOG.query(
    " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS \"column\", {_nulls('v')} AS null_count "
        f"FROM (SELECT CASE WHEN event_type <> 'error' THEN {c} END AS v FROM events)"
        for i, c in enumerate(_EVENTS)
    )
)
def null_counts(spark, root):
    events = table(spark, root, "events")
    gaps = {c: F.when(F.col("event_type") != "error", F.col(c)) for c in events.columns}
    return profile.null_counts(events.withColumns(gaps))


@CATALOG.query(
    " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS name, '{kind}' AS type, "
        f"{_nulls(c)} AS null_count FROM lineitem"
        for i, (c, kind) in enumerate(_LINEITEM)
    )
)
def schema_listing(spark, root):
    return profile.schema_listing(table(spark, root, "lineitem"))


@CATALOG.query(
    " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS \"column\", {_statistics(c)}, "
        f"{_nulls(c)} AS null_count FROM lineitem"
        for i, (c, kind) in enumerate(_LINEITEM)
        if _numeric(kind)
    )
)
def describe_stats(spark, root):
    return _rounded(profile.describe_stats(table(spark, root, "lineitem")))


@CATALOG.query(
    " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS \"column\", "
        f"CAST(count(*) AS VARCHAR) AS count, 'N/A' AS mean, 'N/A' AS stddev, 'N/A' AS min, "
        f"'N/A' AS max, {_nulls(c)} AS null_count FROM documents"
        for i, c in enumerate(("text", "lang", "source"))
    )
)
def describe_fallback(spark, root):
    return profile.describe_text(table(spark, root, "documents").select("text", "lang", "source"))


@CATALOG.query(
    " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS \"column\", '{kind}' AS type, "
        f"count(*) AS rows, {_nulls(c)} AS null_count, "
        f"{_statistics(c) if _numeric(kind) else _NO_STATISTICS} FROM lineitem"
        for i, (c, kind) in enumerate(_LINEITEM)
    )
)
def dataset_summary(spark, root):
    return _rounded(profile.dataset_summary(table(spark, root, "lineitem")))
