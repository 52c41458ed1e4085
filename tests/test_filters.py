import pytest
from pyspark.sql import functions as F

from tillsight.operators.filters import filter_columns, filter_sales, parse_filters


def kept(frame):
    return frame.count()


def test_year_region_category(sales):
    assert kept(filter_sales(sales, year="2016")) == 2
    assert kept(filter_sales(sales, year=2017)) == 2
    assert kept(filter_sales(sales, region="West")) == 2
    assert kept(filter_sales(sales, category="Furniture")) == 3


@pytest.mark.parametrize("none", [None, "", "All"])
def test_no_choice_keeps_everything(sales, none):
    assert kept(filter_sales(sales, none, none, none, None)) == 6


def test_year_must_be_a_number(sales):
    with pytest.raises(ValueError):
        filter_sales(sales, year="next")


def test_year_without_a_year_column(sales):
    assert kept(filter_sales(sales.drop("Year"), year="2016")) == 2


@pytest.mark.parametrize(
    "search, count",
    [("CHAIR", 2), ("  phone ", 1), ("50%", 1), ("%", 1), ("_", 0), ("furn", 3), ("   ", 5), ("", 6)],
)
def test_search_is_literal_and_case_insensitive(sales, search, count):
    assert kept(filter_sales(sales, search=search)) == count


def test_filters_commute(sales):
    one = filter_sales(filter_sales(sales, region="East"), category="Furniture")
    other = filter_sales(filter_sales(sales, category="Furniture"), region="East")
    both = filter_sales(sales, region="East", category="Furniture")
    assert one.collect() == other.collect() == both.collect()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(
        [(1, "a", 1.5, True), (2, "b", 2.0, False), (3, None, None, None)],
        "`a.b` int, `Product Name` string, `x'y` double, flag boolean",
    ).withColumn("on day", F.expr("date'2024-01-01' + `a.b`"))


@pytest.mark.parametrize(
    "filters, count",
    [
        ({"a.b": "2"}, 1),
        ({"a.b": "two"}, 0),
        ({"x'y": "2"}, 1),
        ({"x'y": "2.0", "Product Name": "b"}, 1),
        ({"on day": "2024-01-02"}, 1),
        ({"on day": "soon"}, 0),
        ({"flag": "true"}, 1),
        ({"Product Name": "All", "a.b": ""}, 3),
        ({"unknown": "1"}, 3),
        (None, 3),
    ],
)
def test_dynamic_filters(odd, filters, count):
    assert kept(filter_columns(odd, filters)) == count


def test_request_parameters():
    request = {"filter_Region": "East", "filter_Kind": "All", "filter_x": "", "page": "2"}
    assert parse_filters(request) == {"Region": "East"}


def test_a_year_filter_needs_a_date(sales):
    with pytest.raises(ValueError, match="Order Date"):
        filter_sales(sales.select("Region"), year=2016)
