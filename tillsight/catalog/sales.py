"""Key figures, breakdowns, filters and ranks on the sales table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.catalog.registry import SALES, Catalog
from tillsight.functions.columns import named
from tillsight.operators import breakdowns as bd
from tillsight.operators.filters import filter_columns, filter_sales
from tillsight.operators.ranking import ranked_top, share_of_total
from tillsight.sources.star import sales_totals, sales_view

CATALOG = Catalog()


def cents(frame, *names):
    return frame.withColumns({name: F.round(named(name), 2) for name in names})


@CATALOG.query(
    SALES
    + """
SELECT round(sum("Sales"), 2) AS total_sales, round(sum("Profit"), 2) AS total_profit,
       count("Order ID") AS total_orders, round(avg("Discount") * 100, 2) AS avg_discount
FROM sales
"""
)
def kpi_summary(spark, root):
    totals = sales_totals(
        spark, root, ("Sales", "Profit", "orders", "discount_sum", "discount_count")
    )
    return cents(bd.kpis_of_totals(totals), "total_sales", "total_profit")


@CATALOG.query(SALES + """SELECT round(sum("Sales"), 2) AS total_sales FROM sales""")
def total_sales(spark, root):
    return bd.total_sales(sales_view(spark, root, ("Sales",)))


@CATALOG.query(SALES + """SELECT round(sum("Profit"), 2) AS total_profit FROM sales""")
def total_profit(spark, root):
    return bd.total_profit(sales_totals(spark, root, ("Sales", "Profit")))


@CATALOG.query(SALES + "SELECT count(*) AS total_orders FROM sales")
def total_orders(spark, root):
    return bd.total_orders(sales_view(spark, root, ("Order ID",)))


@CATALOG.query(SALES + """SELECT round(avg("Discount") * 100, 2) AS avg_discount FROM sales""")
def avg_discount(spark, root):
    return bd.avg_discount(sales_view(spark, root, ("Discount",)))


def _by(column: str) -> str:
    return SALES + f"""
SELECT "{column}", round(sum("Sales"), 2) AS total_sales FROM sales GROUP BY ALL
"""


@CATALOG.query(_by("Region"))
def region_sales(spark, root):
    return cents(bd.sales_by(sales_totals(spark, root, ("Region", "Sales")), "Region"), "total_sales")


@CATALOG.query(_by("Category"))
def category_sales(spark, root):
    totals = sales_totals(spark, root, ("Category", "Sales"))
    return cents(bd.sales_by(totals, "Category"), "total_sales")


@CATALOG.query(_by("Segment"))
def segment_sales(spark, root):
    totals = sales_totals(spark, root, ("Segment", "Sales"))
    return cents(bd.sales_by(totals, "Segment"), "total_sales")


@CATALOG.query(
    SALES
    + """
SELECT "Month", month_num, round(sum("Sales"), 2) AS monthly_sales FROM sales
GROUP BY ALL ORDER BY month_num
"""
)
def monthly_sales(spark, root):
    totals = sales_totals(spark, root, ("Month", "month_num", "Sales"))
    return cents(bd.monthly_sales(totals), "monthly_sales")


@CATALOG.query(
    SALES
    + """
SELECT "Year" AS year, month_num, strftime("Order Date", '%b %Y') AS label,
       round(sum("Sales"), 2) AS monthly_sales
FROM sales WHERE "Order Date" IS NOT NULL GROUP BY ALL ORDER BY year, month_num
"""
)
def year_month_series(spark, root):
    totals = sales_totals(spark, root, ("Order Date", "Sales"))
    return cents(bd.year_month_series(totals), "monthly_sales")


@CATALOG.query(
    SALES
    + """
SELECT "Product Name", round(sum("Sales"), 2) AS total_sales,
       round(sum("Profit"), 2) AS total_profit
FROM sales GROUP BY ALL ORDER BY sum("Sales") DESC, "Product Name" LIMIT 5
"""
)
def top_products(spark, root):
    totals = sales_totals(spark, root, ("Product Name", "Sales", "Profit"))
    return cents(bd.top_products(totals), "total_sales", "total_profit")


@CATALOG.query(
    """
SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders
WHERE o_orderdate IS NOT NULL ORDER BY year
"""
)
def year_values(spark, root):
    orders = spark.read.parquet(f"{root}/orders.parquet")
    return bd.years(orders.select(F.year("o_orderdate").alias("Year")))


@CATALOG.query(
    SALES
    + """
, cells AS (
  SELECT grouping("Region") AS g1, grouping("Category") AS g2, grouping("Segment") AS g3,
         grouping("Month") AS g4, "Region", "Category", "Segment", "Month", month_num,
         round(sum("Sales"), 2) AS total_sales
  FROM sales
  GROUP BY GROUPING SETS (("Region"), ("Category"), ("Segment"), ("Month", month_num), ())
)
SELECT CASE WHEN g1 = 0 THEN 'region' WHEN g2 = 0 THEN 'category' WHEN g3 = 0 THEN 'segment'
            WHEN g4 = 0 THEN 'month' ELSE 'total' END AS section,
       CASE WHEN g1 = 0 THEN "Region" WHEN g2 = 0 THEN "Category" WHEN g3 = 0 THEN "Segment"
            WHEN g4 = 0 THEN "Month" END AS label,
       month_num, total_sales
FROM cells
"""
)
def breakdowns_one_pass(spark, root):
    order_totals = sales_totals(spark, root, ("Region", "Segment", "Month", "month_num", "Sales"))
    part_totals = sales_totals(spark, root, ("Category", "Sales"))
    return cents(bd.breakdowns_by_side(order_totals, part_totals), "total_sales")


# Filters ---------------------------------------------------------------------------------


def _rows(where: str, columns: str) -> str:
    return SALES + f"SELECT {columns} FROM sales WHERE {where}"


@CATALOG.query(
    _rows(
        """"Order Date" >= DATE '1997-01-01' AND "Order Date" < DATE '1998-01-01'""",
        '"Order ID", "Order Date", "Year", "Sales"',
    )
)
def filter_year(spark, root):
    sales = sales_view(spark, root, ("Order ID", "Order Date", "Year", "Sales"))
    return filter_sales(sales, year="1997")


@CATALOG.query(_rows(""""Region" = 'ASIA'""", '"Order ID", "Region", "Sales"'))
def filter_region(spark, root):
    return filter_sales(sales_view(spark, root, ("Order ID", "Region", "Sales")), region="ASIA")


@CATALOG.query(_rows(""""Category" = 'ECONOMY'""", '"Order ID", "Category", "Sales"'))
def filter_category(spark, root):
    sales = sales_view(spark, root, ("Order ID", "Category", "Sales"))
    return filter_sales(sales, category="ECONOMY")


@CATALOG.query(
    _rows(
        """contains(lower("Product Name"), 'red') OR contains(lower("Category"), 'red')
        OR contains(lower("Sub-Category"), 'red')""",
        '"Order ID", "Product Name", "Category", "Sub-Category", "Sales"',
    )
)
def filter_search(spark, root):
    sales = sales_view(
        spark, root, ("Order ID", "Product Name", "Category", "Sub-Category", "Sales")
    )
    return filter_sales(sales, search="  ReD ")


@CATALOG.query(
    SALES
    + """
SELECT round(coalesce(sum("Sales"), 0), 2) AS total_sales,
       round(coalesce(sum("Profit"), 0), 2) AS total_profit,
       count("Order ID") AS total_orders,
       round(coalesce(avg("Discount"), 0) * 100, 2) AS avg_discount
FROM sales
WHERE year("Order Date") = 1998 AND "Region" = 'EUROPE' AND "Category" = 'STANDARD'
  AND (contains(lower("Product Name"), 'blue') OR contains(lower("Category"), 'blue')
       OR contains(lower("Sub-Category"), 'blue'))
"""
)
def filter_combined(spark, root):
    sales = filter_sales(sales_view(spark, root), 1998, "EUROPE", "STANDARD", "blue")
    return cents(bd.kpi_summary(sales), "total_sales", "total_profit")


@CATALOG.query(
    """
SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 3 AND l_discount = 0.05
"""
)
def filter_dynamic(spark, root):
    lines = spark.read.parquet(f"{root}/lineitem.parquet")
    return filter_columns(
        lines,
        {
            "l_returnflag": "R",
            "l_linenumber": "3",
            "l_discount": "0.05",
            "l_linestatus": "All",
            "l_tax": "",
            "no_such_column": "x",
        },
    )


# Ranks and shares ------------------------------------------------------------------------


@CATALOG.query(
    SALES
    + """
, top AS (SELECT "Product Name" AS label, sum("Sales") AS v FROM sales GROUP BY ALL
          ORDER BY v DESC, label LIMIT 10)
SELECT CAST(row_number() OVER (ORDER BY v DESC, label) AS INTEGER) AS rank, label,
       round(v, 2) AS value, round(v / sum(v) OVER () * 100, 1) AS share_pct
FROM top
"""
)
def top_items_share(spark, root):
    totals = bd.sales_by(sales_totals(spark, root, ("Product Name", "Sales")), "Product Name")
    return cents(ranked_top(totals, "Product Name", "total_sales"), "value")


@CATALOG.query(
    SALES
    + """
, s AS (SELECT "Segment" AS label, sum("Sales") AS v FROM sales GROUP BY ALL)
SELECT label, round(v, 2) AS value, round(v / (SELECT sum(v) FROM s) * 100, 1) AS share_pct
FROM s
"""
)
def segment_share(spark, root):
    totals = bd.sales_by(sales_totals(spark, root, ("Segment", "Sales")), "Segment")
    return cents(share_of_total(totals, "Segment", "total_sales"), "value")
