"""Dashboard and report documents."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tillsight.operators import breakdowns as bd
from tillsight.operators.filters import filter_sales
from tillsight.plans import reports
from tillsight.plans.dashboard import SECTIONS, Dashboard


@pytest.mark.parametrize(
    "filters",
    [{}, {"year": "2016"}, {"region": "West"}, {"category": "Furniture", "search": "chair"}],
)
def test_sections_equal_single_queries(sales, filters):
    kept = filter_sales(sales, **filters)
    with Dashboard(sales, **filters) as board:
        assert rows(board.kpis()) == rows(bd.kpi_summary(kept))
        assert sorted(map(str, rows(board.regions()))) == sorted(map(str, rows(bd.sales_by(kept, "Region"))))
        assert sorted(map(str, rows(board.categories()))) == sorted(map(str, rows(bd.sales_by(kept, "Category"))))
        assert sorted(map(str, rows(board.segments()))) == sorted(map(str, rows(bd.sales_by(kept, "Segment"))))
        assert rows(board.months()) == rows(bd.monthly_sales(kept))
        assert rows(board.top_products()) == rows(bd.top_products(kept))
        assert rows(board.years()) == [("2016",), ("2017",)]


def test_nothing_left_after_the_filter(sales):
    with Dashboard(sales, region="Nowhere") as board:
        assert rows(board.kpis()) == [(0.0, 0.0, 0, 0.0)]
        assert board.regions().count() == board.top_products().count() == 0
        assert rows(board.forecast()) == [(0, "none", 0.0, 0.0, 0.0, "up")]
        assert board.forecast_points().count() == 0
        assert rows(board.years()) == [("2016",), ("2017",)]


def test_cells_made_elsewhere(sales):
    parts = sales.withColumns({
        "orders": F.col("`Order ID`").isNotNull().cast("int"),
        "discount_sum": F.col("Discount"),
        "discount_count": F.col("Discount").isNotNull().cast("int"),
    }).drop("Order ID", "Discount", "Region", "Segment", "Month", "month_num", "Order Date")
    orders = sales.select("Region", "Segment", "Month", "month_num", "Order Date", "Sales")
    cells = bd.cells_by_side(orders, parts, SECTIONS)
    with Dashboard(None, cells=cells) as one, Dashboard(sales) as other:
        for section in ("kpis", "months", "top_products", "years", "forecast", "history"):
            assert rows(getattr(one, section)()) == rows(getattr(other, section)())
        for section in ("regions", "categories", "segments"):
            found = [sorted(map(str, rows(getattr(b, section)()))) for b in (one, other)]
            assert found[0] == found[1]
    with pytest.raises(ValueError):
        Dashboard(None)
    with pytest.raises(ValueError):
        Dashboard(sales, cells=cells)


def test_sections_can_be_narrowed(sales):
    with Dashboard(sales.select("Region", "Sales"), sections=(bd.REGION,)) as board:
        assert board.regions().count() == 4
        with pytest.raises(ValueError):
            board.months()


def test_closing_leaves_a_kept_dataset_alone(sales):
    kept = sales.persist()
    try:
        with Dashboard(kept) as board:
            board.kpis().collect()
        assert kept.is_cached and kept.storageLevel.useMemory
    finally:
        kept.unpersist()


def test_documents(sales):
    with Dashboard(sales) as board:
        found = {}
        for section, text in rows(board.documents()):
            found.setdefault(section, []).append(json.loads(text))
    assert found["kpis"] == [
        {"total_sales": "₹650.75", "total_profit": "₹25.0", "total_orders": "5", "avg_discount": "10.0%"}
    ]
    assert {e.get("label"): e["value"] for e in found["regions"]}["West"] == 350.25
    assert found["forecast"][0]["trend_class"] in ("up", "down")
    assert [e["label"] for e in found["history"]] and len(found["forecast_points"]) == 3
    assert found["top_products"][0]["product_name"] == "Red Chair"


def test_summary_sheet(sales):
    with Dashboard(sales) as board:
        sheet = rows(reports.report_summary(board))
    assert [(r[2], r[3]) for r in sheet if r[0] == "kpi"] == [
        ("Total Sales", 650.75), ("Total Profit", 25.0), ("Total Orders", 5.0), ("Average Discount", 0.1),
    ]
    assert [r[2] for r in sheet if r[0] == "product"][:2] == ["Red Chair", "Phone"]


def test_trend_sheet(sales):
    with Dashboard(sales) as board:
        sheet = rows(reports.report_trends(board))
    assert {r[0] for r in sheet} == {"month", "category", "region"}
    assert ("month", 1, "Jan", 300.5) in sheet


def test_breakdown_fills_the_shorter_side(sales):
    with Dashboard(sales) as board:
        table = sorted(rows(reports.report_breakdown(board)))
        products = rows(reports.report_products(board))
    assert [r[0] for r in table] == [1, 2, 3, 4]
    assert table[0][1:] == ("West", "₹350.25", "Consumer", "₹300.5")
    assert products[0] == (1, "Red Chair", "₹400.75", "₹40.0", "text-green")


def test_forecast_sheet_and_overlay(spark):
    data = [(f"{1 + i % 12}/1/{2020 + i // 12}", 1000.0 + 10 * i) for i in range(30)]
    frame = spark.createDataFrame(data, "d string, Sales double").select(
        F.to_date("d", "M/d/yyyy").alias("Order Date"), "Sales",
        *[F.lit("x").alias(c) for c in ("Region", "Category", "Segment", "Product Name", "Order ID")],
        F.lit(0.0).alias("Profit"), F.lit(0.0).alias("Discount"),
    ).withColumns({
        "Month": F.date_format("Order Date", "MMM"), "Year": F.year("Order Date"),
        "month_num": F.month("Order Date"),
    })
    with Dashboard(frame) as board:
        sheet = rows(reports.report_forecast(board))
        lines = rows(reports.forecast_overlay(board))
    assert [r[1] for r in sheet] == ["Jul 2022", "Aug 2022", "Sep 2022"]
    assert [r[4] for r in sheet] == list(reports.RECOMMENDATIONS)
    history = sorted((r[1], r[2]) for r in lines if r[0] == "history")
    ahead = sorted((r[1], r[2], r[3]) for r in lines if r[0] == "forecast")
    assert [p for p, _ in history] == list(range(-11, 1))
    assert ahead[0] == (0, "Jun 2022", 1290.0) and [p for p, _, _ in ahead] == [0, 1, 2, 3]
    assert all(r[4] == r[3] / 1000 for r in lines)


def test_later_recommendations(spark):
    points = spark.range(1, 6).select(
        F.col("id").cast("int").alias("step"), F.lit("x").alias("label"), F.lit(1.0).alias("forecast")
    )
    texts = [r[4] for r in rows(reports.recommended(points))]
    assert texts[3:] == [reports.LATER_RECOMMENDATION] * 2


def test_sheets_are_written_apart(spark, sales, tmp_path):
    with Dashboard(sales) as board:
        reports.write_sheets(
            {"summary": reports.report_summary(board), "trends": reports.report_trends(board)},
            str(tmp_path / "report"),
        )
    assert spark.read.option("header", True).csv(str(tmp_path / "report" / "summary")).count() == 4 + 5


def test_a_report_is_written_as_a_whole(spark, sales, tmp_path):
    folder = str(tmp_path / "report")
    with Dashboard(sales) as board:
        sheets = {"summary": reports.report_summary(board), "trends": reports.report_trends(board)}
        reports.write_report(sheets, folder)
        for name, sheet in sheets.items():
            found = reports.read_sheet(spark, folder, name, sheet.schema)
            assert sorted(map(str, rows(found))) == sorted(map(str, rows(sheet)))
        # another report takes its place, and one that fails leaves it
        reports.write_report({"summary": sheets["summary"]}, folder)
        assert sorted(p.name for p in tmp_path.glob("report/sheet=*")) == ["sheet=summary"]
        broken = sheets["trends"].select(F.raise_error(F.lit("broken")).cast("string").alias("x"))
        with pytest.raises(Exception, match="broken"):
            reports.write_report({"summary": sheets["summary"], "trends": broken}, folder)
    assert [p.name for p in tmp_path.iterdir()] == ["report"]
    assert sorted(p.name for p in tmp_path.glob("report/sheet=*")) == ["sheet=summary"]
