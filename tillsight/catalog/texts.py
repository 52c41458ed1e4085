"""Display texts on whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillsight.catalog.registry import SALES, Catalog, compact_sql, table
from tillsight.functions import dates, numbers
from tillsight.operators import forecast as fc
from tillsight.sources.star import sales_totals, sales_view

CATALOG = Catalog()

_PRODUCT_REGION = SALES + """
, t AS (SELECT "Product Name", "Region", round(sum("Sales"), 2) AS sales,
               round(sum("Profit"), 2) AS profit FROM sales GROUP BY ALL)
"""


def _product_region(spark, root):
    return (
        sales_view(spark, root, ("Product Name", "Region", "Sales", "Profit"))
        .groupBy("Product Name", "Region")
        .agg(F.round(F.sum("Sales"), 2).alias("sales"), F.round(F.sum("Profit"), 2).alias("profit"))
    )


@CATALOG.query(f"SELECT o_orderkey, {compact_sql('o_totalprice')} AS text FROM orders")
def compact_number(spark, root):
    return table(spark, root, "orders").select(
        "o_orderkey", numbers.compact_number(F.col("o_totalprice")).alias("text")
    )


@CATALOG.query(
    _PRODUCT_REGION
    + f"""SELECT "Product Name", "Region", {compact_sql('sales', '₹')} AS sales,
       {compact_sql('profit', '₹')} AS profit FROM t"""
)
def compact_currency(spark, root):
    return _product_region(spark, root).select(
        "Product Name",
        "Region",
        numbers.compact_currency(F.col("sales")).alias("sales"),
        numbers.compact_currency(F.col("profit")).alias("profit"),
    )


@CATALOG.query(
    f"SELECT c_custkey, {compact_sql('c_acctbal', '₹', report=True)} AS text FROM customer"
)
def compact_number_report(spark, root):
    return table(spark, root, "customer").select(
        "c_custkey", numbers.compact_report(F.col("c_acctbal")).alias("text")
    )


@CATALOG.query(
    """
SELECT o_orderkey,
       CASE WHEN o_totalprice >= 100000 THEN '₹' || format('{:.1f}', o_totalprice / 100000) || 'L'
            WHEN o_totalprice >= 1000 THEN
              '₹' || CAST(CAST(floor(o_totalprice / 1000 + 0.5) AS BIGINT) AS VARCHAR) || 'K'
            ELSE '₹' || regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') END AS tick
FROM orders
"""
)
def compact_tick(spark, root):
    return table(spark, root, "orders").select(
        "o_orderkey", numbers.compact_tick(F.col("o_totalprice")).alias("tick")
    )


@CATALOG.query(
    """
SELECT l_orderkey, format('{:,}', l_orderkey * l_suppkey) AS whole_text,
       format('{:,.2f}', l_extendedprice) AS amount_text,
       coalesce(format('{:,.2f}', CASE WHEN l_returnflag <> 'A' THEN l_tax END), 'N/A') AS gap_text
FROM lineitem
"""
)
def format_thousands(spark, root):
    lines = table(spark, root, "lineitem")
    long, double = lines.schema["l_orderkey"].dataType, lines.schema["l_tax"].dataType
    gappy = F.when(F.col("l_returnflag") != "A", F.col("l_tax"))
    return lines.select(
        "l_orderkey",
        numbers.thousands(F.col("l_orderkey") * F.col("l_suppkey"), long).alias("whole_text"),
        numbers.thousands(F.col("l_extendedprice"), double).alias("amount_text"),
        numbers.thousands(gappy, double).alias("gap_text"),
    )


@CATALOG.query(
    SALES
    + """
, m AS (SELECT date_trunc('month', "Order Date") AS p, sum("Sales") AS v FROM sales GROUP BY ALL),
c AS (SELECT strftime(p, '%b %Y') AS label, lag(v) OVER (ORDER BY p) AS last, v FROM m),
t AS (SELECT label, round(CASE WHEN last > 0 THEN (v - last) / last * 100 ELSE 0 END, 1) AS trend FROM c)
SELECT label, trend,
       CASE WHEN trend >= 0 THEN '+' ELSE '' END || format('{:.1f}', trend + 0.0) || '%' AS text,
       CASE WHEN trend >= 0 THEN 'up' ELSE 'down' END AS trend_class
FROM t
"""
)
def trend_text(spark, root):
    series = fc.monthly_series(sales_totals(spark, root, ("Order Date", "Sales")))
    last = F.lag("y").over(Window.orderBy("period"))
    trend = F.round(fc.trend_percent(F.col("y"), last), 1)
    return series.select(dates.month_label(F.col("period")).alias("label"), trend.alias("trend")).select(
        "label",
        "trend",
        numbers.trend_text(F.col("trend")).alias("text"),
        numbers.trend_class(F.col("trend")).alias("trend_class"),
    )


@CATALOG.query(
    _PRODUCT_REGION
    + """SELECT "Product Name", "Region", profit,
       CASE WHEN profit >= 0 THEN 'text-green' ELSE 'text-danger' END AS profit_class FROM t"""
)
def profit_class(spark, root):
    return _product_region(spark, root).select(
        "Product Name", "Region", "profit", numbers.profit_class(F.col("profit")).alias("profit_class")
    )
