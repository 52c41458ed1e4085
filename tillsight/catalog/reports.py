"""Dashboard document and report extracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.catalog.forecast_sql import NEXTS, forecast_ctes, points_select
from tillsight.catalog.forecasts import _sales_series_sql
from tillsight.catalog.registry import SALES, SALES_BODY, Catalog, compact_sql
from tillsight.operators import breakdowns as bd
from tillsight.plans import reports
from tillsight.plans.dashboard import SECTIONS, Dashboard
from tillsight.plans.holding import NOT, PLAN
from tillsight.sources.shared import delete_at_exit, shared_folder
from tillsight.sources.star import sales_totals, sales_view

CATALOG = Catalog()

TREND_SECTIONS = (bd.MONTH, bd.CATEGORY, bd.REGION)


def board(spark, root, sections=SECTIONS) -> Dashboard:
    """The unfiltered dashboard of the star schema, one pass per side.

    All sections of a plan read its few cells from one shuffle; nothing stays in memory.
    """
    orders = ("Region", "Segment", "Month", "month_num", "Order Date", "Sales")
    parts = ("Category", "Product Name", "Sales", "Profit", "orders", "discount_sum", "discount_count")
    cells = bd.cells_by_side(
        sales_totals(spark, root, orders), sales_totals(spark, root, parts), sections
    )
    return Dashboard(None, sections=sections, cells=cells, hold=PLAN)


def forecast_board(spark, root) -> Dashboard:
    totals = sales_totals(spark, root, ("Order Date", "Sales"))
    return Dashboard(totals, sections=(bd.PERIOD,), hold=PLAN)


def _rounded(frame, *names):
    return frame.withColumns({name: F.round(name, 2) for name in names})


_AMOUNT = "CAST(round({}, 2) AS DECIMAL(38, 2))"


def _groups_json(section: str, column: str) -> str:
    return f"""SELECT '{section}' AS section,
  CAST(to_json({{'label': "{column}", 'value': {_AMOUNT.format('sum("Sales")')}}}) AS VARCHAR) AS json
FROM sales GROUP BY "{column}\""""


def _dashboard_sql(body: str = SALES_BODY) -> str:
    """The document of a dashboard over the sales rows of ``body``; years are those of all."""
    return (
        "WITH "
        + forecast_ctes(_sales_series_sql([], body), [])
        + f""", {NEXTS}, ahead AS ({points_select([])}), sales AS ({body}),
k AS (SELECT sum("Sales") AS s, sum("Profit") AS p, count("Order ID") AS n,
             round(avg("Discount") * 100, 2) AS d FROM sales),
t AS (SELECT "Product Name" AS label, sum("Sales") AS s, sum("Profit") AS p FROM sales
      GROUP BY ALL ORDER BY s DESC, label LIMIT 5)
SELECT 'kpis' AS section, CAST(to_json({{
    'total_sales': {compact_sql('s', '₹')}, 'total_profit': {compact_sql('p', '₹')},
    'total_orders': format('{{:,}}', n),
    'avg_discount': regexp_replace(format('{{:.2f}}', d), '0$', '') || '%'}}) AS VARCHAR) AS json FROM k
UNION ALL SELECT DISTINCT 'years', CAST(to_json({{'year': CAST("Year" AS VARCHAR)}}) AS VARCHAR)
FROM ({SALES_BODY})
UNION ALL {_groups_json('regions', 'Region')}
UNION ALL {_groups_json('categories', 'Category')}
UNION ALL {_groups_json('segments', 'Segment')}
UNION ALL SELECT 'months', CAST(to_json({{'position': month_num, 'label': "Month",
    'value': {_AMOUNT.format('sum("Sales")')}}}) AS VARCHAR) FROM sales GROUP BY month_num, "Month"
UNION ALL SELECT 'top_products', CAST(to_json({{'product_name': label,
    'total_sales': {compact_sql('s', '₹')}, 'total_profit': {compact_sql('p', '₹')},
    'profit_class': CASE WHEN p >= 0 THEN 'text-green' ELSE 'text-danger' END}}) AS VARCHAR) FROM t
UNION ALL SELECT 'forecast', CAST(to_json({{'forecast_value': {compact_sql('round(value, 2)', '₹')},
    'forecast_trend': CASE WHEN round(trend, 1) >= 0 THEN '+' ELSE '' END
      || format('{{:.1f}}', round(trend, 1)) || '%',
    'trend_class': CASE WHEN trend >= 0 THEN 'up' ELSE 'down' END,
    'forecast_accuracy': format('{{:.1f}}', accuracy) || '%'}}) AS VARCHAR) FROM nexts
UNION ALL SELECT 'forecast_points', CAST(to_json({{'position': step, 'label': label,
    'value': {_AMOUNT.format('forecast')}}}) AS VARCHAR) FROM ahead
UNION ALL SELECT 'history', CAST(to_json({{'period': CAST(period AS VARCHAR),
    'label': strftime(period, '%b %Y'), 'value': {_AMOUNT.format('y')}}}) AS VARCHAR) FROM series
"""
    )


@CATALOG.query(_dashboard_sql())
def dashboard_json(spark, root):
    return board(spark, root).documents()


# A filtered request: a year, a region, a category and a text in the product's name.
_ASKED = {"year": 1996, "region": "EUROPE", "category": "STANDARD", "search": "e"}
_FILTERED_BODY = f"""SELECT * FROM ({SALES_BODY})
  WHERE year("Order Date") = 1996 AND "Region" = 'EUROPE' AND "Category" = 'STANDARD'
    AND (contains(lower("Product Name"), 'e') OR contains(lower("Category"), 'e')
         OR contains(lower("Sub-Category"), 'e'))"""


@CATALOG.query(_dashboard_sql(_FILTERED_BODY))
def dashboard_filtered_json(spark, root):
    return Dashboard(sales_view(spark, root), **_ASKED, hold=PLAN).documents()


@CATALOG.query(
    f"""
WITH sales AS ({_FILTERED_BODY})
SELECT 'month' AS block, month_num, "Month" AS label, round(sum("Sales"), 2) AS value
FROM sales GROUP BY ALL
UNION ALL SELECT 'category', NULL, "Category", round(sum("Sales"), 2) FROM sales GROUP BY ALL
UNION ALL SELECT 'region', NULL, "Region", round(sum("Sales"), 2) FROM sales GROUP BY ALL
"""
)
def report_trends_filtered(spark, root):
    asked = Dashboard(sales_view(spark, root), **_ASKED, sections=TREND_SECTIONS, hold=NOT)
    return _rounded(reports.report_trends(asked), "value")


_SUMMARY_SQL = (
    SALES
    + """
, k AS (SELECT round(sum("Sales"), 2) AS s, round(sum("Profit"), 2) AS p, count("Order ID") AS n,
               round(round(avg("Discount") * 100, 2) / 100, 4) AS d FROM sales),
t AS (SELECT "Product Name" AS label, sum("Sales") AS s, sum("Profit") AS p FROM sales GROUP BY ALL
      ORDER BY s DESC, label LIMIT 5)
SELECT 'kpi' AS block, CAST(1 AS INTEGER) AS pos, 'Total Sales' AS label, s AS value,
       CAST(NULL AS DOUBLE) AS profit FROM k
UNION ALL SELECT 'kpi', 2, 'Total Profit', p, NULL FROM k
UNION ALL SELECT 'kpi', 3, 'Total Orders', CAST(n AS DOUBLE), NULL FROM k
UNION ALL SELECT 'kpi', 4, 'Average Discount', d, NULL FROM k
UNION ALL SELECT 'product', CAST(row_number() OVER (ORDER BY s DESC, label) AS INTEGER), label,
                 round(s, 2), round(p, 2) FROM t
"""
)


@CATALOG.query(_SUMMARY_SQL)
def report_summary(spark, root):
    parts = ("Product Name", "Sales", "Profit", "orders", "discount_sum", "discount_count")
    totals = sales_totals(spark, root, parts)
    sheet = reports.report_summary(Dashboard(totals, sections=(bd.TOTAL, bd.PRODUCT), hold=PLAN))
    digits = F.when(F.col("label") == "Average Discount", F.round("value", 4))
    return _rounded(sheet.withColumn("value", digits.otherwise(F.round("value", 2))), "profit")


_TRENDS_SQL = (
    SALES
    + """
SELECT 'month' AS block, month_num, "Month" AS label, round(sum("Sales"), 2) AS value
FROM sales GROUP BY ALL
UNION ALL SELECT 'category', NULL, "Category", round(sum("Sales"), 2) FROM sales GROUP BY ALL
UNION ALL SELECT 'region', NULL, "Region", round(sum("Sales"), 2) FROM sales GROUP BY ALL
"""
)


@CATALOG.query(_TRENDS_SQL)
def report_trends(spark, root):
    cells = bd.cells_by_side(
        sales_totals(spark, root, ("Region", "Month", "month_num", "Sales")),
        sales_totals(spark, root, ("Category", "Sales")),
        TREND_SECTIONS,
    )
    trends = reports.report_trends(Dashboard(None, sections=TREND_SECTIONS, cells=cells, hold=NOT))
    return _rounded(trends, "value")


_BREAKDOWN_SQL = (
    SALES
    + f"""
, r AS (SELECT row_number() OVER (ORDER BY v DESC, region NULLS LAST) AS pos, region,
               {compact_sql('v', '₹')} AS region_sales
        FROM (SELECT "Region" AS region, sum("Sales") AS v FROM sales GROUP BY ALL)),
s AS (SELECT row_number() OVER (ORDER BY v DESC, segment NULLS LAST) AS pos, segment,
             {compact_sql('v', '₹')} AS segment_sales
      FROM (SELECT "Segment" AS segment, sum("Sales") AS v FROM sales GROUP BY ALL))
SELECT coalesce(r.pos, s.pos) AS pos, region, region_sales, segment, segment_sales
FROM r FULL JOIN s ON r.pos = s.pos
"""
)


@CATALOG.query(_BREAKDOWN_SQL)
def report_breakdown(spark, root):
    totals = sales_totals(spark, root, ("Region", "Segment", "Sales"))
    return reports.report_breakdown(Dashboard(totals, sections=(bd.REGION, bd.SEGMENT), hold=NOT))


_PRODUCTS_SQL = (
    SALES
    + f"""
, t AS (SELECT "Product Name" AS product_name, sum("Sales") AS s, sum("Profit") AS p
        FROM sales GROUP BY ALL ORDER BY s DESC, product_name LIMIT 5)
SELECT CAST(row_number() OVER (ORDER BY s DESC, product_name) AS INTEGER) AS pos, product_name,
       {compact_sql('s', '₹')} AS sales, {compact_sql('p', '₹')} AS profit,
       CASE WHEN p >= 0 THEN 'text-green' ELSE 'text-danger' END AS profit_class
FROM t
"""
)


@CATALOG.query(_PRODUCTS_SQL)
def report_products(spark, root):
    totals = sales_totals(spark, root, ("Product Name", "Sales", "Profit"))
    return reports.report_products(Dashboard(totals, sections=(bd.PRODUCT,), hold=NOT))


_TOTAL = "WITH " + forecast_ctes(_sales_series_sql([]), [])


_FORECAST_SELECT = (
    f", table_rows AS ({points_select([])})"
    + f"""
SELECT step, label AS period, forecast, {compact_sql('forecast', '₹', report=True)} AS forecast_text,
       CASE step WHEN 1 THEN 'Normal operation. Review inventory limits.'
                 WHEN 2 THEN 'Expected period transition. Stock alignment recommended.'
                 WHEN 3 THEN 'Extended projection. Strategy plan check.'
                 ELSE 'Strategy plan check.' END AS recommendation
FROM table_rows
"""
)


@CATALOG.query(_TOTAL + _FORECAST_SELECT)
def report_forecast(spark, root):
    return reports.report_forecast(forecast_board(spark, root))


@CATALOG.query(
    _TOTAL
    + f", ahead AS ({points_select([])})"
    + """
, recent AS (SELECT 1 - row_number() OVER (ORDER BY period DESC) AS pos,
                    strftime(period, '%b %Y') AS label, round(y, 2) AS value
             FROM (SELECT * FROM series ORDER BY period DESC LIMIT 12)),
lines AS (
  SELECT 'history' AS line, pos, label, value FROM recent
  UNION ALL SELECT 'forecast', pos, label, value FROM recent WHERE pos = 0
  UNION ALL SELECT 'forecast', step, label, forecast FROM ahead)
SELECT line, CAST(pos AS INTEGER) AS pos, label, value, value / 1000 AS thousands FROM lines
"""
)
def forecast_overlay(spark, root):
    return reports.forecast_overlay(forecast_board(spark, root))


_FILTERED = f"WITH sales AS ({_FILTERED_BODY})"


def _asked(spark, root, *sections) -> Dashboard:
    return Dashboard(sales_view(spark, root), **_ASKED, sections=sections, hold=PLAN)


@CATALOG.query(_SUMMARY_SQL.replace(SALES, _FILTERED))
def report_summary_filtered(spark, root):
    sheet = reports.report_summary(_asked(spark, root, bd.TOTAL, bd.PRODUCT))
    digits = F.when(F.col("label") == "Average Discount", F.round("value", 4))
    return _rounded(sheet.withColumn("value", digits.otherwise(F.round("value", 2))), "profit")


@CATALOG.query(_BREAKDOWN_SQL.replace(SALES, _FILTERED))
def report_breakdown_filtered(spark, root):
    return reports.report_breakdown(_asked(spark, root, bd.REGION, bd.SEGMENT))


@CATALOG.query(_PRODUCTS_SQL.replace(SALES, _FILTERED))
def report_products_filtered(spark, root):
    return reports.report_products(_asked(spark, root, bd.PRODUCT))


@CATALOG.query(
    "WITH " + forecast_ctes(_sales_series_sql([], _FILTERED_BODY), []) + _FORECAST_SELECT
)
def report_forecast_filtered(spark, root):
    return reports.report_forecast(_asked(spark, root, bd.PERIOD))


@CATALOG.query(
    f"""
SELECT 'summary' AS sheet, block, label, value FROM ({_SUMMARY_SQL})
UNION ALL SELECT 'trends', block, label, value FROM ({_TRENDS_SQL})
"""
)
def report_written(spark, root):
    """Both sheets, written together and read back."""
    folder = shared_folder(spark)
    delete_at_exit(spark, folder)
    sheets = {"summary": report_summary(spark, root), "trends": report_trends(spark, root)}
    reports.write_report(sheets, folder)
    parts = [
        reports.read_sheet(spark, folder, name, sheet.schema).select(
            F.lit(name).alias("sheet"), "block", "label", "value"
        )
        for name, sheet in sheets.items()
    ]
    return parts[0].unionByName(parts[1])
