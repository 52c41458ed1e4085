import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tillsight.operators import breakdowns as bd
from tillsight.operators.ranking import ranked_top, share_of_total


def test_kpis(sales):
    assert bd.kpi_summary(sales).first().asDict() == {
        "total_sales": 650.75,
        "total_profit": 25.0,
        "total_orders": 5,
        "avg_discount": 10.0,
    }
    assert bd.total_sales(sales).first()[0] == 650.75
    assert bd.total_profit(sales).first()[0] == 25.0
    assert bd.total_orders(sales).first()[0] == 6
    assert bd.avg_discount(sales).first()[0] == 10.0


def test_empty_table_gives_zeros(empty_sales):
    assert tuple(bd.kpi_summary(empty_sales).first()) == (0.0, 0.0, 0, 0.0)
    for single in (bd.total_sales, bd.total_profit, bd.total_orders, bd.avg_discount):
        assert single(empty_sales).first()[0] == 0
    assert bd.top_products(empty_sales).count() == 0
    assert bd.years(empty_sales).count() == 0


def test_groups_without_any_amount_are_zero(sales):
    found = dict(rows(bd.sales_by(sales, "Region")))
    assert found == {"East": 300.5, "West": 350.25, "Void": 0.0, None: 0.0}


def test_breakdowns_sum_to_the_total(sales):
    total = bd.total_sales(sales).first()[0]
    for column in ("Region", "Category", "Segment"):
        amounts = [row[1] for row in rows(bd.sales_by(sales, column))]
        assert math.isclose(sum(amounts), total)


def test_monthly_profile_spans_years(sales):
    assert rows(bd.monthly_sales(sales)) == [(None, None, 50.0), ("Jan", 1, 300.5), ("Dec", 12, 300.25)]


def test_series_leaves_undated_rows_out(sales):
    assert rows(bd.year_month_series(sales)) == [
        (2016, 1, "Jan 2016", 300.5),
        (2017, 12, "Dec 2017", 300.25),
    ]


def test_top_products_with_ties(spark):
    frame = spark.createDataFrame(
        [(n, v, 1.0) for n, v in [("b", 5.0), ("a", 5.0), ("f", 5.0), ("e", 5.0), ("d", 9.0), ("c", 5.0), ("z", None)]],
        "`Product Name` string, Sales double, Profit double",
    )
    assert [row[0] for row in rows(bd.top_products(frame))] == ["d", "a", "b", "c", "e"]


def test_years(sales):
    assert rows(bd.years(sales)) == [("2016",), ("2017",)]


def test_one_pass_equals_separate_queries(sales):
    cells = rows(bd.breakdowns_one_pass(sales))
    for section, column in (("region", "Region"), ("category", "Category"), ("segment", "Segment")):
        found = {label: v for s, label, _, v in cells if s == section}
        assert found == dict(rows(bd.sales_by(sales, column)))
    months = {(label, m): v for s, label, m, v in cells if s == "month"}
    assert months == {(a, b): v for a, b, v in rows(bd.monthly_sales(sales))}
    assert [v for s, _, _, v in cells if s == "total"] == [650.75]


def test_sides_equal_one_pass(sales):
    found = bd.breakdowns_by_side(sales.drop("Category"), sales.select("Category", "Sales"))
    assert sorted(map(str, rows(found))) == sorted(map(str, rows(bd.breakdowns_one_pass(sales))))


def test_cells_do_not_confuse_null_groups_with_other_sections(sales):
    cells = bd.sales_cells(sales).where(F.col("section") == "region")
    assert cells.count() == 4
    assert cells.where(F.col("Region").isNull()).count() == 1


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame(
        [("a", 50.0), ("b", 30.0), ("c", 20.0), ("d", None), (None, 100.0)], "g string, v double"
    )


def test_rank_and_share_of_the_listed(groups):
    assert rows(ranked_top(groups, "g", "v", 2)) == [
        (1, None, 100.0, 66.7),
        (2, "a", 50.0, 33.3),
    ]


def test_share_is_zero_without_a_positive_total(spark):
    frame = spark.createDataFrame([("a", 0.0), ("b", -1.0)], "g string, v double")
    assert {row[3] for row in rows(ranked_top(frame, "g", "v"))} == {0.0}


def test_share_of_all_groups(groups):
    found = {row[0]: row[2] for row in rows(share_of_total(groups, "g", "v"))}
    assert found == {"a": 25.0, "b": 15.0, "c": 10.0, "d": 0.0, None: 50.0}


def test_cells_of_one_side_only(sales):
    found = bd.cells_by_side(sales.drop("Category"), sales.select("Category", "Sales"), ("region",))
    assert {r["section"] for r in found.collect()} == {"region"} and found.count() == 4
    found = bd.cells_by_side(sales.drop("Category"), sales.select("Category", "Sales"), ("category",))
    assert {r["section"] for r in found.collect()} == {"category"}


def test_shown_cells_keep_the_best_products_and_all_else(sales):
    cells = bd.sales_cells(sales, ("region", "product", "total"))
    best = [r["Product Name"] for r in bd.shown(cells, 2).where("section = 'product'").collect()]
    assert sorted(best) == ["Phone", "Red Chair"]
    assert bd.shown(cells, 2).where("section <> 'product'").count() == 5
