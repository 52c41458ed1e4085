"""Registration of queries and the SQL fragments they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None):
        """Register a function under its name, with the equivalent SQL if there is one."""

        def register(function: Query) -> Query:
            key = name or function.__name__
            self.queries[key] = function
            if sql is not None:
                self.oracles[key] = sql.strip()
            return function

        return register


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


# The sales table of the star schema in SQL; see tillsight.sources.star.
SALES_BODY = """
  SELECT l_orderkey AS "Order ID",
         CAST(o_orderdate AS DATE) AS "Order Date",
         strftime(o_orderdate, '%b') AS "Month",
         CAST(year(o_orderdate) AS INTEGER) AS "Year",
         CAST(month(o_orderdate) AS INTEGER) AS month_num,
         r_name AS "Region", c_mktsegment AS "Segment",
         p_type AS "Category", p_brand AS "Sub-Category", p_name AS "Product Name",
         floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 AS "Sales",
         l_discount AS "Discount",
         floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100
           - l_quantity * p_retailprice AS "Profit"
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN part ON l_partkey = p_partkey
"""
SALES = f"WITH sales AS ({SALES_BODY})"


def compact_sql(value: str, prefix: str = "", report: bool = False) -> str:
    """SQL text for the compact number forms; ``format`` rounds half-to-even."""

    def short(x):
        return f"regexp_replace(format('{{:.2f}}', {x}), '0$', '')"

    size = value if report else f"abs({value})"
    crore = "" if report else f"WHEN {size} >= 10000000 THEN '{prefix}' || {short(f'{size} / 10000000')} || 'Cr' "
    text = (
        f"CASE {crore}"
        f"WHEN {size} >= 100000 THEN '{prefix}' || {short(f'{size} / 100000')} || 'L' "
        f"WHEN {size} >= 1000 THEN '{prefix}' || {short(f'{size} / 1000')} || 'K' "
        f"ELSE '{prefix}' || {short(size)} END"
    )
    return text if report else f"CASE WHEN {value} < 0 THEN '-' ELSE '' END || {text}"
