"""Forecasts, their parts and the month model."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillsight.catalog.forecast_sql import boosted_ctes, forecast_ctes, points_select, summary_select
from tillsight.catalog.registry import SALES, SALES_BODY, Catalog, table
from tillsight.functions import dates
from tillsight.operators import adaptive as ad
from tillsight.operators import forecast as fc
from tillsight.operators.boosted import boosted_forecast, pick_of_three
from tillsight.operators.roles import classify
from tillsight.sources.shared import delete_at_exit, shared_folder
from tillsight.sources.star import sales_totals, sales_view

CATALOG = Catalog()


def _sales_series_sql(keys: list[str], body: str = SALES_BODY) -> str:
    k = "".join(f'"{key}", ' for key in keys)
    return f"""
  SELECT {k}CAST(date_trunc('month', "Order Date") AS DATE) AS period, month("Order Date") AS month_num,
         sum("Sales") AS y
  FROM ({body}) WHERE "Order Date" IS NOT NULL GROUP BY ALL
"""


_REGION = ["Region"]
_REGION_CTES = "WITH " + forecast_ctes(_sales_series_sql(_REGION), _REGION)
_TOTAL_CTES = "WITH " + forecast_ctes(_sales_series_sql([]), [])


def region_series(spark, root):
    return fc.monthly_series(sales_totals(spark, root, ("Region", "Order Date", "Sales")), _REGION)


def total_series(spark, root):
    return fc.monthly_series(sales_totals(spark, root, ("Order Date", "Sales")))


def _rounded(frame, digits, *names):
    return frame.withColumns({name: F.round(name, digits) for name in names})


@CATALOG.query(
    SALES
    + """
, m AS (SELECT "Region", CAST(date_trunc('month', "Order Date") AS DATE) AS period,
               month_num, sum("Sales") AS y FROM sales GROUP BY ALL)
SELECT "Region", period, month_num, round(y, 2) AS y,
       CAST(row_number() OVER (PARTITION BY "Region" ORDER BY period) - 1 AS INTEGER) AS t FROM m
"""
)
def series_index(spark, root):
    return _rounded(fc.series_index(region_series(spark, root), _REGION), 2, "y")


@CATALOG.query(
    SALES
    + """
, m AS (SELECT "Region", CAST(date_trunc('month', "Order Date") AS DATE) AS period,
               month_num, sum("Sales") AS y FROM sales GROUP BY ALL)
SELECT "Region", period, month_num, round(y, 2) AS y,
       CAST(row_number() OVER (PARTITION BY "Region" ORDER BY period) - 1 AS INTEGER) AS t,
       round(sin(2 * pi() * month_num / 12.0), 9) AS sin_m,
       round(cos(2 * pi() * month_num / 12.0), 9) AS cos_m FROM m
"""
)
def fc_features(spark, root):
    features = fc.features(region_series(spark, root), _REGION)
    # adding zero turns a rounded -0.0 into 0.0
    features = _rounded(_rounded(features, 2, "y"), 9, "sin_m", "cos_m")
    return features.withColumns({c: F.col(c) + F.lit(0.0) for c in ("sin_m", "cos_m")})


def _coefficients_sql(model: str) -> str:
    return (
        _REGION_CTES
        + f"""
SELECT "Region", n, round(intercept, 2) AS intercept, round(slope, 2) AS slope,
       round(coef_sin, 2) AS coef_sin, round(coef_cos, 2) AS coef_cos, round(r2, 6) AS r2
FROM candidates WHERE model = '{model}'
"""
    )


def _coefficients(spark, root, model):
    fit = fc.fit_one(region_series(spark, root), model, _REGION)
    return _rounded(_rounded(fit, 2, "intercept", "slope", "coef_sin", "coef_cos"), 6, "r2")


@CATALOG.query(_coefficients_sql(fc.LINEAR))
def fc_linear(spark, root):
    return _coefficients(spark, root, fc.LINEAR)


@CATALOG.query(_coefficients_sql(fc.RIDGE))
def fc_ridge(spark, root):
    return _coefficients(spark, root, fc.RIDGE)


_FUTURE = """CAST(step AS INTEGER) AS step,
       strftime(last_period + to_months(CAST(step AS INTEGER)), '%b %Y') AS label,
       CAST(future_month AS INTEGER) AS month_num"""


@CATALOG.query(
    "WITH RECURSIVE "
    + forecast_ctes(_sales_series_sql([]), [])
    + boosted_ctes([])
    + f"""
SELECT {_FUTURE}, round(greatest(0, forecast), 2) AS forecast, round(score, 6) AS score, round(r2, 6) AS r2
FROM boosted
"""
)
def fc_gbt(spark, root):
    return _rounded(boosted_forecast(total_series(spark, root)), 6, "score", "r2")


@CATALOG.query(
    _REGION_CTES + """SELECT "Region", model, round(r2, 6) AS r2 FROM candidates"""
)
def fc_r2(spark, root):
    candidates = fc.fit_candidates(region_series(spark, root), _REGION)
    return _rounded(candidates.select("Region", "model", "r2"), 6, "r2")


@CATALOG.query(
    _REGION_CTES
    + """, sizes AS (SELECT DISTINCT "Region", fold, first, size FROM fold_rows WHERE fold > 0)
SELECT a."Region", CAST(a.fold AS INTEGER) AS fold, b.first AS train_months, b.size AS test_months,
       model, round(r2, 6) AS r2
FROM scored a JOIN sizes b ON a."Region" = b."Region" AND a.fold = b.fold
"""
)
def forecast_cv(spark, root):
    return _rounded(fc.cross_validation(region_series(spark, root), _REGION), 6, "r2")


@CATALOG.query(
    _REGION_CTES
    + """SELECT "Region", n, model, round(score, 6) AS score, round(r2, 6) AS r2 FROM picked"""
)
def forecast_pick(spark, root):
    picked = fc.pick_for(region_series(spark, root), _REGION)
    return _rounded(picked.select("Region", "n", "model", "score", "r2"), 6, "score", "r2")


@CATALOG.query(_TOTAL_CTES + points_select([]))
def forecast_monthly(spark, root):
    return fc.forecast(total_series(spark, root))


@CATALOG.query(
    "WITH RECURSIVE "
    + forecast_ctes(_sales_series_sql(_REGION), _REGION)
    + boosted_ctes(_REGION)
    + f"""
SELECT "Region", {_FUTURE}, round(forecast, 2) AS forecast, model, round(score, 6) AS score,
       round(r2, 6) AS r2
FROM three
"""
)
def forecast_best_of_three(spark, root):
    """Every region by the best of ridge, least squares and boosted trees."""
    picked = pick_of_three(region_series(spark, root), _REGION)
    points = fc.forecast_points(picked, _REGION, carry=("model", "score", "r2"))
    return _rounded(points, 6, "score", "r2")


@CATALOG.query(_REGION_CTES + summary_select(_REGION))
def forecast_trend(spark, root):
    return fc.forecast_summary(fc.pick_for(region_series(spark, root), _REGION), _REGION)


@CATALOG.query(_REGION_CTES + points_select(_REGION))
def forecast_by_region(spark, root):
    return fc.forecast(region_series(spark, root), _REGION)


# One short series per customer and priority: one to a handful of months each.
_SHORT = ["o_custkey", "o_orderpriority"]


@CATALOG.query(
    "WITH "
    + forecast_ctes(
        """SELECT o_custkey, o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
           month(o_orderdate) AS month_num, sum(o_totalprice * 1.0000137) AS y FROM orders GROUP BY ALL""",
        _SHORT,
    )
    + summary_select(_SHORT)
)
def forecast_short(spark, root):
    # A factor takes the amounts off exact halves, which two engines may round either way.
    orders = table(spark, root, "orders").withColumns(
        {
            "o_orderdate": F.col("o_orderdate").cast("date"),
            "o_totalprice": F.col("o_totalprice") * F.lit(1.0000137),
        }
    )
    series = fc.monthly_series(orders, _SHORT, "o_orderdate", "o_totalprice")
    return fc.forecast_summary(fc.pick_for(series, _SHORT), _SHORT)


@CATALOG.query(
    """
WITH ends AS (SELECT o_custkey, CAST(date_trunc('month', max(o_orderdate)) AS DATE) AS last_period
              FROM orders GROUP BY ALL),
f AS (SELECT *, unnest(range(1, 4)) AS step FROM ends)
SELECT o_custkey, CAST(step AS INTEGER) AS step,
       CAST(month(last_period + to_months(CAST(step AS INTEGER))) AS INTEGER) AS month_num,
       strftime(last_period + to_months(CAST(step AS INTEGER)), '%b %Y') AS label
FROM f
"""
)
def future_months(spark, root):
    ends = (
        table(spark, root, "orders")
        .groupBy("o_custkey")
        .agg(F.max("o_orderdate").cast("date").alias("day"))
        .select("o_custkey", dates.month_start(F.col("day")).alias("last_period"))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(fc.HORIZON))))
    )
    return ends.select(
        "o_custkey",
        "step",
        fc.future_month(F.month("last_period"), F.col("step")).alias("month_num"),
        fc.future_label(F.col("last_period"), F.col("step")).alias("label"),
    )


_PERIODS = """SELECT label AS period, CAST(substring(label, 6, 2) AS INTEGER) AS month_num, y
        FROM (SELECT strftime(o_orderdate, '%Y-%m') AS label, sum(o_totalprice) AS y
              FROM orders GROUP BY ALL)"""


def _compact_sql(points: str) -> str:
    return f"""
, f AS (SELECT round(forecast, 2) AS value, round(greatest(0.0, least(99.0, r2 * 100)), 1) AS acc,
               round(CASE WHEN last_y > 0 THEN (forecast - last_y) / last_y * 100 ELSE 0 END, 1) AS trend
        FROM {points} WHERE step = 1)
SELECT 'Next Period o_totalprice' AS label, value, format('{{:,.2f}}', value) AS value_text,
       CASE WHEN trend >= 0 THEN '+' ELSE '' END || format('{{:.1f}}', trend) || '%' AS trend,
       CASE WHEN trend >= 0 THEN 'up' ELSE 'down' END AS trend_class,
       format('{{:.1f}}', acc) || '%' AS accuracy
FROM f
"""


@CATALOG.query("WITH " + forecast_ctes(_PERIODS, []) + _compact_sql("points"))
def dyn_forecast(spark, root):
    orders = table(spark, root, "orders")
    return ad.dyn_forecast(orders, classify(orders, "o_totalprice"))


@CATALOG.query(
    "WITH RECURSIVE " + forecast_ctes(_PERIODS, []) + boosted_ctes([]) + _compact_sql("three")
)
def dyn_forecast_of_three(spark, root):
    """The compact forecast with boosted trees among the candidates."""
    orders = table(spark, root, "orders")
    return ad.dyn_forecast(orders, classify(orders, "o_totalprice"), boosted=True)


@CATALOG.query(
    SALES
    + """
SELECT round(regr_slope("Sales", month_num), 6) AS slope,
       round(regr_intercept("Sales", month_num), 6) AS intercept,
       CAST(regr_count("Sales", month_num) AS BIGINT) AS rows
FROM sales
"""
)
def month_model(spark, root):
    model = fc.month_model(sales_view(spark, root, ("Order Date", "Sales")))
    return _rounded(model, 6, "slope", "intercept")



@CATALOG.query(
    SALES
    + """
, m AS (SELECT regr_slope("Sales", month_num) AS a, regr_intercept("Sales", month_num) AS b FROM sales)
SELECT CAST(month AS INTEGER) AS month_num, round(b + a * month, 6) AS predicted
FROM m, (SELECT unnest(range(1, 13)) AS month)
"""
)
def month_model_saved(spark, root):
    """The month model, saved, loaded and applied to every month."""
    folder = shared_folder(spark)
    fc.save_model(fc.month_model(sales_view(spark, root, ("Order Date", "Sales"))), folder)
    delete_at_exit(spark, folder)
    months = spark.range(1, 13).select(F.col("id").cast("int").alias("month_num"))
    predicted = fc.apply_month_model(spark.read.parquet(folder), F.col("month_num"))
    return months.withColumn("predicted", F.round(predicted, 6))
