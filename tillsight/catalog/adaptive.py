"""Schema-adaptive sections on tables of different make-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.catalog.forecast_sql import forecast_ctes
from tillsight.catalog.registry import SALES, SALES_BODY, Catalog, table
from tillsight.operators import adaptive as ad
from tillsight.operators.roles import classify, column_roles
from tillsight.plans.analysis import analyze
from tillsight.plans.holding import NOT, PLAN
from tillsight.sources.star import sales_view

CATALOG = Catalog()

# The sales table as an uploaded table would come: a date, a number and three categories.
UPLOAD = ("Order Date", "Sales", "Region", "Category", "Segment")


def roles_sql(source: str, columns: list[tuple[str, str, str]]) -> str:
    """One SQL row per column: (ordinal, column, type, role, filled)."""
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS ordinal, '{name}' AS \"column\", '{kind}' AS type, "
        f"'{role}' AS role, count({name}) AS filled FROM {source}"
        for i, (name, kind, role) in enumerate(columns)
    )


_ORDERS_ROLES = [
    ("o_orderkey", "bigint", "numeric"),
    ("o_custkey", "bigint", "numeric"),
    ("o_orderstatus", "string", "categorical"),
    ("o_totalprice", "double", "numeric"),
    ("o_orderdate", "timestamp_ntz", "date"),
    ("o_orderpriority", "string", "categorical"),
]


@CATALOG.query(roles_sql("orders", _ORDERS_ROLES), name="column_roles")
def orders_roles(spark, root):
    return column_roles(table(spark, root, "orders"))


# Part: three text columns with 64, 25 and 6 values; the first is too wide for a filter.
_PART_VALUES = """
WITH pairs AS (
  SELECT DISTINCT 0 AS ordinal, 'p_name' AS "column", p_name AS value FROM part UNION ALL
  SELECT DISTINCT 1, 'p_brand', p_brand FROM part UNION ALL
  SELECT DISTINCT 2, 'p_type', p_type FROM part
), kept AS (
  SELECT ordinal, "column", count(*) AS n_distinct FROM pairs GROUP BY ALL
  HAVING count(*) BETWEEN 2 AND 40 ORDER BY ordinal LIMIT 3
)
"""


@CATALOG.query(
    _PART_VALUES + 'SELECT CAST(ordinal AS INTEGER) AS ordinal, "column", n_distinct FROM kept'
)
def filter_candidates(spark, root):
    part = table(spark, root, "part")
    return ad.filter_candidates(part, classify(part))


@CATALOG.query(
    _PART_VALUES
    + """SELECT CAST(ordinal AS INTEGER) AS ordinal, "column", value FROM pairs
WHERE value IS NOT NULL AND "column" IN (SELECT "column" FROM kept)"""
)
def filter_values(spark, root):
    part = table(spark, root, "part")
    return ad.filter_values(part, classify(part))


@CATALOG.query(
    """
WITH p AS (SELECT strftime(o_orderdate, '%Y-%m') AS label, sum(o_totalprice) AS total
           FROM orders GROUP BY ALL ORDER BY label NULLS FIRST LIMIT 36)
SELECT CAST(row_number() OVER (ORDER BY label NULLS FIRST) AS INTEGER) AS pos,
       coalesce(label, 'None') AS label, round(coalesce(total, 0), 2) AS value
FROM p
"""
)
def dyn_trend(spark, root):
    orders = table(spark, root, "orders")
    points = ad.dyn_trend(orders, classify(orders, "o_totalprice"))
    return points.withColumn("value", F.round("value", 2))


@CATALOG.query(
    """
WITH p AS (SELECT p_name AS label, sum(p_retailprice) AS total FROM part GROUP BY ALL
           ORDER BY round(total, 2) DESC NULLS LAST, label LIMIT 10)
SELECT CAST(row_number() OVER (ORDER BY round(total, 2) DESC, label) AS INTEGER) AS pos, label,
       round(total, 2) AS value
FROM p
"""
)
def dyn_top_category(spark, root):
    part = table(spark, root, "part")
    points = ad.dyn_top_category(part, classify(part, "p_retailprice"))
    return points.withColumn("value", F.round("value", 2))


def _counts(column: str, limit: int) -> str:
    return f"""
WITH p AS (SELECT {column} AS label, count(*) AS n FROM part GROUP BY ALL
           ORDER BY n DESC, label LIMIT {limit})
SELECT CAST(row_number() OVER (ORDER BY n DESC, label) AS INTEGER) AS pos, label,
       CAST(n AS DOUBLE) AS value
FROM p
"""


@CATALOG.query(_counts("p_brand", 10))
def dyn_distribution_2(spark, root):
    part = table(spark, root, "part")
    return ad.dyn_distribution(part, classify(part), 1)


@CATALOG.query(_counts("p_type", 8))
def dyn_distribution_3(spark, root):
    part = table(spark, root, "part")
    return ad.dyn_distribution(part, classify(part), 2)


@CATALOG.query(
    """
WITH s AS (SELECT CAST(sum(l_orderkey) AS BIGINT) AS a, CAST(sum(l_partkey) AS BIGINT) AS b,
                  CAST(sum(l_suppkey) AS BIGINT) AS c, CAST(sum(l_linenumber) AS BIGINT) AS d
           FROM lineitem)
SELECT CAST(0 AS INTEGER) AS pos, 'kpi_0' AS id, 'Total l_orderkey' AS title,
       CAST(a AS DOUBLE) AS value, format('{:,}', a) AS value_text FROM s
UNION ALL SELECT 1, 'kpi_1', 'Total l_partkey', CAST(b AS DOUBLE), format('{:,}', b) FROM s
UNION ALL SELECT 2, 'kpi_2', 'Total l_suppkey', CAST(c AS DOUBLE), format('{:,}', c) FROM s
UNION ALL SELECT 3, 'kpi_3', 'Total l_linenumber', CAST(d AS DOUBLE), format('{:,}', d) FROM s
"""
)
def dyn_kpis(spark, root):
    lines = table(spark, root, "lineitem")
    return ad.dyn_kpis(lines, classify(lines))


@CATALOG.query(
    """
WITH m AS (SELECT event_type, count(*) AS n FROM events GROUP BY ALL
           ORDER BY n DESC, event_type LIMIT 1)
SELECT CAST(0 AS INTEGER) AS pos, 'Top event_type' AS title, event_type AS value,
       'Highest frequency — ' || format('{:,}', n) || ' records' AS description FROM m
UNION ALL
SELECT 1, 'Avg event_id', format('{:,.2f}', avg(event_id)),
       'Dataset average across all records' FROM events
UNION ALL
SELECT 2, 'Peak event_id', format('{:,}', max(event_id)),
       'Maximum single value in dataset' FROM events
"""
)
def dyn_insights(spark, root):
    events = table(spark, root, "events")
    return ad.dyn_insights(events, classify(events))


@CATALOG.query(
    SALES
    + """
, trend AS (SELECT strftime("Order Date", '%Y-%m') AS label, sum("Sales") AS v FROM sales
            GROUP BY ALL ORDER BY label NULLS FIRST LIMIT 36),
top AS (SELECT "Region" AS label, sum("Sales") AS v FROM sales GROUP BY ALL
        ORDER BY v DESC, label LIMIT 10),
second AS (SELECT "Category" AS label, count(*) AS v FROM sales GROUP BY ALL
           ORDER BY v DESC, label LIMIT 10),
third AS (SELECT "Segment" AS label, count(*) AS v FROM sales GROUP BY ALL
          ORDER BY v DESC, label LIMIT 8)
SELECT 'chart_0' AS chart_id, 'Sales Trend Over Time' AS title, 'line' AS type,
       CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS pos, label,
       round(v, 2) AS value FROM trend
UNION ALL
SELECT 'chart_1', 'Top Region by Sales', 'bar',
       CAST(row_number() OVER (ORDER BY v DESC, label) AS INTEGER), label, round(v, 2) FROM top
UNION ALL
SELECT 'chart_2', 'Distribution by Category', 'doughnut',
       CAST(row_number() OVER (ORDER BY v DESC, label) AS INTEGER), label, CAST(v AS DOUBLE) FROM second
UNION ALL
SELECT 'chart_3', 'Distribution by Segment', 'pie',
       CAST(row_number() OVER (ORDER BY v DESC, label) AS INTEGER), label, CAST(v AS DOUBLE) FROM third
"""
)
def dyn_charts(spark, root):
    charts = analyze(sales_view(spark, root, UPLOAD), hold=NOT).charts()
    return charts.withColumn("value", F.round("value", 2))


@CATALOG.query(
    """
WITH t AS (SELECT c_name AS label, sum(c_acctbal) AS v FROM customer GROUP BY ALL
           ORDER BY v DESC NULLS LAST, label LIMIT 10)
SELECT CAST(row_number() OVER (ORDER BY v DESC, label) AS INTEGER) AS rank, label,
       round(v, 2) AS value, round(v / sum(v) OVER () * 100, 1) AS share_pct,
       format('{:,.2f}', v) AS value_text
FROM t
"""
)
def top_items_ranked(spark, root):
    customers = table(spark, root, "customer")
    return ad.top_items(customers, classify(customers, "c_acctbal")).withColumn(
        "value", F.round("value", 2)
    )


@CATALOG.query(
    """
SELECT * FROM orders
ORDER BY o_totalprice DESC, o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority
LIMIT 10
"""
)
def dyn_preview(spark, root):
    orders = table(spark, root, "orders")
    return ad.preview(orders, classify(orders, "o_totalprice"))


@CATALOG.query("SELECT lang, source FROM documents ORDER BY lang, source LIMIT 10")
def dyn_preview_any(spark, root):
    texts = table(spark, root, "documents").select("lang", "source")
    return ad.preview(texts, classify(texts))


_TREND_SERIES = """
  SELECT label AS period, CAST(substring(label, 6, 2) AS INTEGER) AS month_num, y
  FROM (SELECT strftime("Order Date", '%Y-%m') AS label, sum("Sales") AS y FROM sales GROUP BY ALL)
"""


def _chart_sql(number: int, title: str, kind: str, points: str) -> str:
    return f"""(SELECT {{'id': 'chart_{number}', 'title': '{title}', 'type': '{kind}',
      'labels': list(label ORDER BY pos), 'values': list(CAST(v AS DECIMAL(38, 2)) ORDER BY pos)}} FROM {points})"""


def _choice_sql(column: str) -> str:
    return f"""{{'column': '{column}', 'values': (SELECT list(v ORDER BY v) FROM (SELECT DISTINCT "{column}" AS v FROM base))}}"""


def _ranked_sql(column: str, value: str, limit: int) -> str:
    return f"""SELECT row_number() OVER (ORDER BY v DESC, label) AS pos, label, v
  FROM (SELECT "{column}" AS label, {value} AS v FROM sales GROUP BY ALL ORDER BY v DESC, label LIMIT {limit})"""


_ANALYSIS_SQL = f"""
WITH base AS (SELECT "Order Date", "Sales", "Region", "Category", "Segment" FROM ({SALES_BODY})),
sales AS (SELECT * FROM base WHERE "Category" = 'STANDARD'),
{forecast_ctes(_TREND_SERIES, [])},
trend AS (SELECT row_number() OVER (ORDER BY label) AS pos, label, v
          FROM (SELECT strftime("Order Date", '%Y-%m') AS label, sum("Sales") AS v FROM sales
                GROUP BY ALL ORDER BY label LIMIT 36)),
regions AS ({_ranked_sql('Region', 'sum("Sales")', 10)}),
second AS ({_ranked_sql('Category', 'count(*)', 10)}),
third AS ({_ranked_sql('Segment', 'count(*)', 8)}),
ahead AS (SELECT round(forecast, 2) AS value, round(greatest(0.0, least(99.0, r2 * 100)), 1) AS acc,
                 round(CASE WHEN last_y > 0 THEN (forecast - last_y) / last_y * 100 ELSE 0 END, 1) AS trend
          FROM points WHERE step = 1),
often AS (SELECT "Region" AS v, count(*) AS n FROM sales GROUP BY ALL ORDER BY n DESC, v LIMIT 1),
k AS (SELECT count(*) AS n, sum("Sales") AS s, avg("Sales") AS m, max("Sales") AS p FROM sales),
best AS (SELECT * FROM sales
         ORDER BY "Sales" DESC, "Order Date", "Region", "Category", "Segment" LIMIT 10)
SELECT CAST(to_json({{
  'shape': {{'rows': n, 'columns': 5, 'shape': format('{{:,}}', n) || ' rows × 5 columns'}},
  'columns': {{'all': ['Order Date', 'Sales', 'Region', 'Category', 'Segment'], 'numeric': ['Sales'],
              'categorical': ['Region', 'Category', 'Segment'], 'date': ['Order Date']}},
  'filters': [{', '.join(map(_choice_sql, ('Region', 'Category', 'Segment')))}],
  'kpis': [{{'id': 'kpi_0', 'title': 'Total Sales', 'value_text': format('{{:,.2f}}', s),
            'value': CAST(s AS DECIMAL(38, 2))}}],
  'charts': [{_chart_sql(0, 'Sales Trend Over Time', 'line', 'trend')},
             {_chart_sql(1, 'Top Region by Sales', 'bar', 'regions')},
             {_chart_sql(2, 'Distribution by Category', 'doughnut', 'second')},
             {_chart_sql(3, 'Distribution by Segment', 'pie', 'third')}],
  'top_items': (SELECT list({{'rank': pos, 'label': label, 'value_text': format('{{:,.2f}}', v),
                             'value': CAST(v AS DECIMAL(38, 2)), 'share_pct': share}} ORDER BY pos)
                FROM (SELECT *, round(v / sum(v) OVER () * 100, 1) AS share FROM regions)),
  'forecast': (SELECT {{'label': 'Next Period Sales', 'value_text': format('{{:,.2f}}', value),
                       'trend': CASE WHEN trend >= 0 THEN '+' ELSE '' END || format('{{:.1f}}', trend) || '%',
                       'trend_class': CASE WHEN trend >= 0 THEN 'up' ELSE 'down' END,
                       'accuracy': format('{{:.1f}}', acc) || '%'}} FROM ahead),
  'insights': [{{'title': 'Top Region', 'value': (SELECT v FROM often),
                'description': 'Highest frequency — ' || (SELECT format('{{:,}}', n) FROM often) || ' records'}},
               {{'title': 'Avg Sales', 'value': format('{{:,.2f}}', m),
                'description': 'Dataset average across all records'}},
               {{'title': 'Peak Sales', 'value': format('{{:,.2f}}', p),
                'description': 'Maximum single value in dataset'}}],
  'preview': (SELECT list(b) FROM best b)}}) AS VARCHAR) AS json
FROM k
"""


@CATALOG.query(_ANALYSIS_SQL)
def analysis_json(spark, root):
    """The whole analysis of a filtered table as one document."""
    asked = analyze(sales_view(spark, root, UPLOAD), {"Category": "STANDARD"}, hold=PLAN)
    return asked.document()
