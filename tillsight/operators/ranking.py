"""Positions, ranks and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.operators.breakdowns import or_zero


def share_percent(value: Column, total: Column) -> Column:
    """Percent of the total with one decimal; 0 where the total is not positive."""
    return F.when(total > 0, F.round(value / total * 100, 1)).otherwise(F.lit(0.0))


def ranked_top(
    groups: DataFrame, label: str, value: str, limit: int = 10, carry: tuple[str, ...] = ()
) -> DataFrame:
    """The largest ``limit`` groups with rank and share of the listed total.

    Only the ``limit`` rows that are left reach the windows. Null values rank last and
    count as zero.
    """
    top = groups.orderBy(F.desc(value), F.asc(label)).limit(limit)
    by_rank = Window.orderBy(F.desc(value), F.asc(label))
    listed = F.sum(or_zero(F.col(value))).over(Window.partitionBy())
    return top.select(
        F.row_number().over(by_rank).alias("rank"),
        F.col(label).alias("label"),
        or_zero(F.col(value)).alias("value"),
        share_percent(or_zero(F.col(value)), listed).alias("share_pct"),
        *carry,
    )


def share_of_total(groups: DataFrame, label: str, value: str) -> DataFrame:
    """Share of every group in the total of all groups.

    The total is a scalar subquery over the groups: the groups stay distributed, however
    many there are.
    """
    total = groups.agg(F.sum(or_zero(F.col(value)))).scalar()
    amount = or_zero(F.col(value))
    share = F.when(total != 0, F.round(amount / total * 100, 1)).otherwise(F.lit(0.0))
    return groups.select(
        F.col(label).alias("label"), amount.alias("value"), share.alias("share_pct")
    )
