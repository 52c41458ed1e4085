"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node reachable, for each node of ``links(a, b)``.

    Alternating stars: each node hands its larger neighbours to the smallest node it knows,
    then its smaller ones. The number of links never grows, and the rounds grow with the
    logarithm of the nodes. Each round is written to the shared folder; the driver sees one
    count and one checksum. Nodes that are their own label and linked with nothing do not occur.
    """
    edges = stored(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        large = (
            both.join(low, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("low", "a").alias("b"))
        )
        # Every row of large has a > b.
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", "low"), F.struct(F.col("b").alias("a"), "low"))).alias("e"))
            .select(F.col("e.a").alias("a"), F.col("e.low").alias("b"))
            .where("a <> b")
            .distinct()
        )
        edges = stored(small, "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    # Stars: every edge leads from a node to the smallest of its component.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
