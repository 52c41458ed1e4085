"""Sales tables assembled from the star schema of order lines, orders, customers and parts.

Two shapes are offered:

* :func:`sales_view` keeps one row per order line;
* :func:`sales_totals` sums the lines per foreign key before joining, for questions that
  only add amounts up.

Both join only the tables that the wanted columns need. All joins are left joins from
lines to the unique key of the other table, so leaving one out never changes the rows.
Customers and their regions are joined to the orders first, so that the lines, the largest
table, are shuffled once by order and once by part at most. No side is forced to be
broadcast: Spark does that where its size statistics allow, and splits skewed partitions
of the line side at run time otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.functions import dates
from tillsight.functions.columns import named

REGION_COLUMNS = ("Region",)
CUSTOMER_COLUMNS = ("Region", "Segment")
DATE_COLUMNS = ("Order Date", "Month", "Year", "month_num")
ORDER_COLUMNS = CUSTOMER_COLUMNS + DATE_COLUMNS
PART_LABELS = {"Category": "p_type", "Sub-Category": "p_brand", "Product Name": "p_name"}
PART_COLUMNS = tuple(PART_LABELS) + ("Profit",)
LINE_COLUMNS = ("Order ID", "Sales", "Discount")
SALES_COLUMNS = LINE_COLUMNS + ORDER_COLUMNS + PART_COLUMNS


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def _whole_cents(amount: Column) -> Column:
    return F.floor(amount * 100 + 0.5) / 100


def _line_sales() -> Column:
    return _whole_cents(F.col("l_extendedprice") * (1 - F.col("l_discount")))


def _orders(spark: SparkSession, root: str, wanted: set[str]) -> DataFrame:
    """Wanted order and customer columns, keyed by ``l_orderkey``."""
    orders = _table(spark, root, "orders")
    if wanted & set(CUSTOMER_COLUMNS):
        customers = _table(spark, root, "customer").withColumnRenamed("c_mktsegment", "Segment")
        if "Region" in wanted:
            nations = _table(spark, root, "nation").join(
                _table(spark, root, "region").withColumnRenamed("r_name", "Region"),
                F.col("n_regionkey") == F.col("r_regionkey"),
                "left",
            )
            customers = customers.join(
                nations, F.col("c_nationkey") == F.col("n_nationkey"), "left"
            )
        orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    day = F.col("o_orderdate").cast("date")
    parts = {
        "Order Date": day,
        "Month": dates.month_name(day),
        "Year": F.year(day),
        "month_num": F.month(day),
    }
    columns = [
        parts[name].alias(name) if name in parts else named(name)
        for name in ORDER_COLUMNS
        if name in wanted
    ]
    return orders.select(F.col("o_orderkey").alias("l_orderkey"), *columns)


def _parts(spark: SparkSession, root: str, wanted: set[str]) -> DataFrame:
    """Wanted part labels, keyed by ``l_partkey``, with the price where profit is wanted."""
    labels = [F.col(c).alias(name) for name, c in PART_LABELS.items() if name in wanted]
    price = [F.col("p_retailprice")] if "Profit" in wanted else []
    return _table(spark, root, "part").select(
        F.col("p_partkey").alias("l_partkey"), *labels, *price
    )


def sales_view(
    spark: SparkSession, root: str, columns: Iterable[str] = SALES_COLUMNS
) -> DataFrame:
    """One row per order line with the wanted columns of the sales contract."""
    columns = tuple(columns)
    wanted = set(columns)
    lines = _table(spark, root, "lineitem")
    if wanted & set(PART_COLUMNS):
        lines = lines.join(_parts(spark, root, wanted), "l_partkey", "left")
    if wanted & set(ORDER_COLUMNS):
        lines = lines.join(_orders(spark, root, wanted), "l_orderkey", "left")
    sales = _line_sales()
    computed = {
        "Order ID": F.col("l_orderkey"),
        "Sales": sales,
        "Discount": F.col("l_discount"),
        "Profit": sales - F.col("l_quantity") * F.col("p_retailprice"),
    }
    return lines.select(
        *[computed[c].alias(c) if c in computed else named(c) for c in columns]
    )


def sales_totals(spark: SparkSession, root: str, columns: Iterable[str]) -> DataFrame:
    """Amounts summed per order or per part, joined to the wanted labels.

    Fits questions that only add up ``Sales`` (and, by part, ``Profit``) or the counts
    ``orders``, ``discount_sum`` and ``discount_count``: the sums of these sums are the sums
    of the lines. Summing before the join means that a key which holds
    much of the table has collapsed to one row per task before anything is shuffled.
    Columns of orders and of parts cannot be mixed here; :func:`sales_view` mixes them.
    """
    columns = tuple(columns)
    wanted = set(columns)
    by_order, by_part = wanted & set(ORDER_COLUMNS), wanted & set(PART_COLUMNS)
    if by_order and by_part:
        raise ValueError("sales_totals takes columns of orders or of parts, not both")
    lines = _table(spark, root, "lineitem").withColumn("Sales", _line_sales())
    counted = {
        "orders": F.count("l_orderkey"),
        "discount_sum": F.sum("l_discount"),
        "discount_count": F.count("l_discount"),
    }
    sums = [F.sum("Sales").alias("Sales")]
    sums += [column.alias(name) for name, column in counted.items() if name in wanted]
    if not by_order and not by_part:
        return lines.agg(*sums).select(*[named(c) for c in columns])
    if by_part:
        if "Profit" in wanted:
            sums.append(F.sum("l_quantity").alias("l_quantity"))
        totals = lines.groupBy("l_partkey").agg(*sums)
        joined = totals.join(_parts(spark, root, wanted), "l_partkey", "left")
        if "Profit" in wanted:
            joined = joined.withColumn(
                "Profit", F.col("Sales") - F.col("l_quantity") * F.col("p_retailprice")
            )
        return joined.select(*[named(c) for c in columns])
    totals = lines.groupBy("l_orderkey").agg(*sums)
    return totals.join(_orders(spark, root, wanted), "l_orderkey", "left").select(
        *[named(c) for c in columns]
    )
