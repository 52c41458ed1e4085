"""Report extracts, one DataFrame per sheet or table."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.functions.columns import named, rows_from
from tillsight.functions.numbers import compact_currency, compact_report, profit_class
from tillsight.operators import breakdowns as bd
from tillsight.plans.dashboard import Dashboard
from tillsight.plans.positions import spread_places

HISTORY_POINTS = 12
NULLS_KEPT = {"ignoreNullFields": "false"}
# Names of the key figures in the summary sheet.
FIGURES = ("Total Sales", "Total Profit", "Total Orders", "Average Discount")
# Texts of the forecast table by position, and the one for later positions.
RECOMMENDATIONS = (
    "Normal operation. Review inventory limits.",
    "Expected period transition. Stock alignment recommended.",
    "Extended projection. Strategy plan check.",
)
LATER_RECOMMENDATION = "Strategy plan check."


def report_summary(board: Dashboard) -> DataFrame:
    """First sheet: the key figures and the top products, (block, pos, label, value, profit)."""
    figures = rows_from(
        board.kpis(),
        [
            {
                "block": F.lit("kpi"),
                "pos": F.lit(pos),
                "label": F.lit(label),
                "value": value.cast("double"),
                "profit": F.lit(None).cast("double"),
            }
            for pos, (label, value) in enumerate(
                zip(
                    FIGURES,
                    (
                        F.col("total_sales"),
                        F.col("total_profit"),
                        F.col("total_orders"),
                        F.col("avg_discount") / 100,
                    ),
                ),
                start=1,
            )
        ],
    )
    by_sales = Window.orderBy(F.desc("total_sales"), F.asc("Product Name"))
    products = board.top_products().select(
        F.lit("product").alias("block"),
        F.row_number().over(by_sales).alias("pos"),
        named("Product Name").alias("label"),
        F.col("total_sales").alias("value"),
        F.col("total_profit").alias("profit"),
    )
    return figures.unionByName(products)


def report_trends(board: Dashboard) -> DataFrame:
    """Second sheet: months, categories and regions as (block, month_num, label, value)."""
    cells = board.sections(bd.MONTH, bd.CATEGORY, bd.REGION)
    return bd.labelled(cells).select(
        F.col("section").alias("block"), "month_num", "label", F.col("total_sales").alias("value")
    )


def report_breakdown(board: Dashboard) -> DataFrame:
    """Regions and segments side by side, largest first; the shorter side ends in blanks.

    The groups of each side are numbered range by range, and a position holds one group of
    either side.
    """
    listed = bd.labelled(board.sections(bd.REGION, bd.SEGMENT)).select("section", "label", "total_sales")
    numbered = spread_places(listed, "section", "total_sales", "label")

    def side(section: str, value):
        return F.max(F.when(F.col("section") == section, value))

    amount = compact_currency(F.col("total_sales"))
    return numbered.groupBy(F.col("pos").cast("long").alias("pos")).agg(
        side(bd.REGION, F.col("label")).alias("region"),
        side(bd.REGION, amount).alias("region_sales"),
        side(bd.SEGMENT, F.col("label")).alias("segment"),
        side(bd.SEGMENT, amount).alias("segment_sales"),
    )


def report_products(board: Dashboard) -> DataFrame:
    """Top products with display texts."""
    by_sales = Window.orderBy(F.desc("total_sales"), F.asc("Product Name"))
    return board.top_products().select(
        F.row_number().over(by_sales).alias("pos"),
        named("Product Name").alias("product_name"),
        compact_currency(F.col("total_sales")).alias("sales"),
        compact_currency(F.col("total_profit")).alias("profit"),
        profit_class(F.col("total_profit")).alias("profit_class"),
    )


def recommended(points: DataFrame) -> DataFrame:
    """Forecast table: period, amount and recommendation by position."""
    text = F.lit(LATER_RECOMMENDATION)
    for position, entry in reversed(list(enumerate(RECOMMENDATIONS, start=1))):
        text = F.when(F.col("step") == position, F.lit(entry)).otherwise(text)
    return points.select(
        "step",
        F.col("label").alias("period"),
        "forecast",
        compact_report(F.col("forecast")).alias("forecast_text"),
        text.alias("recommendation"),
    )


def report_forecast(board: Dashboard) -> DataFrame:
    return recommended(board.forecast_points())


def forecast_overlay(board: Dashboard, points: int = HISTORY_POINTS) -> DataFrame:
    """Chart lines: the last months of history, and the forecast tied on to the last of them.

    (line, pos, label, value, thousands); ``pos`` is the place on the shared axis, 0 being
    the last month of history.
    """
    recent = (
        board.history()
        .orderBy(F.desc("period"))
        .limit(points)
        .withColumn("pos", 1 - F.row_number().over(Window.orderBy(F.desc("period"))))
    )
    ahead = board.forecast_points().select(
        F.col("step").alias("pos"), "label", F.col("forecast").alias("value")
    )
    history = recent.select(F.lit("history").alias("line"), "pos", "label", "value")
    tied = recent.where(F.col("pos") == 0).select("pos", "label", "value").unionByName(ahead)
    lines = history.unionByName(tied.select(F.lit("forecast").alias("line"), "pos", "label", "value"))
    return lines.withColumn("thousands", F.col("value") / 1000)


def sheet_lines(sheets: dict[str, DataFrame]) -> DataFrame:
    """All sheets as (sheet, value): a JSON line for each row of a sheet."""
    parts = [
        frame.select(F.lit(name).alias("sheet"), F.to_json(F.struct("*"), NULLS_KEPT).alias("value"))
        for name, frame in sheets.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def write_report(sheets: dict[str, DataFrame], folder: str) -> None:
    """All sheets in one write: a folder of JSON lines for each under ``sheet=…``.

    The write goes to a folder of its own beside the target, which takes the target's name
    when everything is written. A report that fails leaves the target as it was: absent, or
    the report before.
    """
    lines = sheet_lines(sheets)
    spark, target = lines.sparkSession, folder.rstrip("/")
    staged = f"{target}.staged-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        lines.write.partitionBy("sheet").text(staged)
        before = path(f"{staged}-before")
        if files.exists(path(target)) and not files.rename(path(target), before):
            raise OSError(f"{target} can't be replaced")
        if not files.rename(path(staged), path(target)):
            files.rename(before, path(target))
            raise OSError(f"{target} can't be written")
        files.delete(before, True)
    finally:
        files.delete(path(staged), True)


def read_sheet(spark: SparkSession, folder: str, name: str, schema: T.StructType | str) -> DataFrame:
    """One sheet of a written report."""
    return spark.read.schema(schema).json(f"{folder.rstrip('/')}/sheet={name}")


def write_sheets(sheets: dict[str, DataFrame], folder: str, form: str = "csv") -> None:
    """One folder per sheet, written one after the other; CSV sheets carry a header."""
    for name, sheet in sheets.items():
        writer = sheet.write.mode("errorifexists").format(form)
        if form == "csv":
            writer = writer.option("header", True)
        writer.save(f"{folder.rstrip('/')}/{name}")
