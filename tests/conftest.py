import datetime
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tillsight.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    with tempfile.TemporaryDirectory(prefix="tests-") as shared:
        settings = {
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": f"file://{shared}",
        }
        yield local_session(4, "tests", **settings)


SALES_SCHEMA = (
    "`Order ID` string, `Order Date` string, Region string, Category string, "
    "`Sub-Category` string, `Product Name` string, Segment string, "
    "Sales string, Profit string, Discount string"
)

SALES_ROWS = [
    ("O1", "1/5/2016", "East", "Furniture", "Chairs", "Red Chair", "Consumer", "100.5", "10", "0.1"),
    ("O1", "01-06-2016", "East", "Technology", "Phones", "Phone", "Consumer", "200", "-20", "0.2"),
    ("O2", "02/30/2016", "West", "Furniture", "Tables", "Desk", "Corporate", "50", "5", "bad"),
    (None, "12/31/2017", None, "Office Supplies", "Paper", "50% Paper", "Home", "n/a", None, "0"),
    ("O4", "12/01/2017", "West", "Furniture", "Chairs", "Red Chair", "Home", "300.25", "30", None),
    ("O5", None, "Void", None, None, None, None, None, None, None),
]


@pytest.fixture(scope="session")
def sales(spark):
    from tillsight.sources.sales import type_sales

    return type_sales(spark.createDataFrame(SALES_ROWS, SALES_SCHEMA))


@pytest.fixture(scope="session")
def empty_sales(sales):
    return sales.where("false")


def rows(frame):
    return [tuple(row) for row in frame.collect()]


def day(text):
    return datetime.date.fromisoformat(text)
