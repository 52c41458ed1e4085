"""Positions in long lists, numbered by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.plans.holding import folded


def spread_places(
    frame: DataFrame, group: str, value: str, label: str, ranges: int = 64
) -> DataFrame:
    """Adds ``pos``, the place of each row in its group: largest value first, then by label.

    Approximate quantiles cut each group into ranges, which are numbered apart and moved up by
    the sizes of those before; so a long list is not one task's. Rows of one value are in one
    range. All three passes read ``frame`` from one shuffle.
    """
    rows = folded(frame)
    shares = [i / ranges for i in range(1, ranges)]
    bounds = rows.groupBy(F.col(group).alias("of")).agg(
        F.percentile_approx(value, shares, 100 * ranges).alias("bounds")
    )
    above = F.size(F.filter("bounds", lambda bound: bound > F.col(value)))
    ranged = rows.join(bounds, F.col(group) == F.col("of")).withColumn("range", above).drop("of", "bounds")
    earlier = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(F.col(group).alias("of"), "range")
        .agg(F.count(F.lit(1)).alias("size"))
        .select(
            "of", F.col("range").alias("at"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before")
        )
    )
    inside = Window.partitionBy(group, "range").orderBy(F.desc(value), F.asc_nulls_last(label))
    placed = ranged.withColumn("place", F.row_number().over(inside))
    found = placed.join(offsets, (F.col(group) == F.col("of")) & (F.col("range") == F.col("at")))
    return found.withColumn("pos", F.col("place") + F.col("before")).select(*frame.columns, "pos")
