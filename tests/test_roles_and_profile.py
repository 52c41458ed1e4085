import math
import statistics

import pytest

from conftest import rows
from tillsight.operators import clean, profile
from tillsight.operators.roles import classify, column_roles
from tillsight.plans.summary import summary


@pytest.fixture(scope="module")
def all_types(spark):
    return spark.sql(
        """select 1Y as by, 2S as sh, 3 as i, 4L as l, 1.5F as f, 2.5D as d, 1.25 as dec,
        'x' as txt, 'x' as Holiday, 'x' as lifetime, 'x' as YearMonth, true as flag,
        date'2024-01-01' as d8, timestamp'2024-01-01' as ts, timestamp_ntz'2024-01-01' as ntz,
        array(1) as arr, map('a', 1) as mp, named_struct('a', 1) as st, X'00' as bin"""
    )


def test_roles_of_every_type(all_types):
    roles = classify(all_types)
    assert roles.numeric == ("by", "sh", "i", "l", "f", "d", "dec")
    assert roles.date == ("Holiday", "lifetime", "YearMonth", "d8", "ts", "ntz")
    assert roles.categorical == ("txt",)
    assert roles.primary == "by"
    assert roles.role_of("flag") == roles.role_of("arr") == "other"


def test_primary_can_be_chosen(all_types):
    assert classify(all_types, "d").primary == "d"
    with pytest.raises(ValueError):
        classify(all_types, "txt")


def test_role_table_counts_filled_values(spark):
    frame = spark.createDataFrame([(1, None), (2, "x")], "`a.b` int, `c d` string")
    assert rows(column_roles(frame)) == [
        (0, "a.b", "int", "numeric", 2),
        (1, "c d", "string", "categorical", 1),
    ]


VALUES = [(1, 2.5, "a"), (2, None, "b"), (3, 4.0, None), (None, 1.0, "a")]


@pytest.fixture(scope="module")
def gappy(spark):
    return spark.createDataFrame(VALUES, "`n.o` int, v double, s string")


def test_shape(gappy, spark):
    assert rows(profile.shape(gappy)) == [(4, 3, "4 rows × 3 columns")]
    assert profile.shape(spark.range(1234567)).first()["shape"] == "1,234,567 rows × 1 columns"


def test_null_counts(gappy):
    assert rows(profile.null_counts(gappy)) == [(0, "n.o", 1), (1, "v", 1), (2, "s", 1)]
    assert rows(profile.null_counts(gappy.where("false"))) == [(0, "n.o", 0), (1, "v", 0), (2, "s", 0)]


def test_statistics(gappy):
    found = {row["column"]: row for row in profile.describe_stats(gappy).collect()}
    assert set(found) == {"n.o", "v"}
    v = [2.5, 4.0, 1.0]
    assert found["v"]["count"] == 3
    assert math.isclose(found["v"]["mean"], statistics.mean(v))
    assert math.isclose(found["v"]["stddev"], statistics.stdev(v))
    assert (found["v"]["min"], found["v"]["max"], found["v"]["null_count"]) == (1.0, 4.0, 1)


def test_statistics_as_texts(gappy, spark):
    found = {row["column"]: tuple(row)[2:] for row in profile.describe_text(gappy).collect()}
    assert found["n.o"] == ("3", "2.00", "1.00", "1.00", "3.00", 1)
    wide = spark.createDataFrame([(1234567.891,), (None,)], "v double")
    assert tuple(profile.describe_text(wide).first())[2:] == (
        "1", "1,234,567.89", "N/A", "1,234,567.89", "1,234,567.89", 1,
    )


def test_statistics_without_numbers(gappy):
    assert rows(profile.describe_text(gappy.select("s"))) == [
        (0, "s", "4", "N/A", "N/A", "N/A", "N/A", 1)
    ]


def test_decimals_are_profiled_on_request(all_types):
    assert [r["column"] for r in profile.describe_stats(all_types).collect()] == ["i", "l", "f", "d"]
    found = [r["column"] for r in profile.describe_stats(all_types, include_decimal=True).collect()]
    assert found == ["i", "l", "f", "d", "dec"]


def test_summary_is_one_row_per_column(gappy):
    parts = summary(gappy)
    assert [tuple(r)[:5] for r in parts["columns"].collect()] == [
        (0, "n.o", "IntegerType()", 4, 1),
        (1, "v", "DoubleType()", 4, 1),
        (2, "s", "StringType()", 4, 1),
    ]
    assert rows(parts["schema"]) == [
        (0, "n.o", "IntegerType()", 1),
        (1, "v", "DoubleType()", 1),
        (2, "s", "StringType()", 1),
    ]


def test_summary_is_one_pass(gappy):
    parts = summary(gappy)
    try:
        for name, part in parts.items():
            text = part._jdf.queryExecution().withCachedData().toString()
            assert "InMemoryRelation" in text and "count_if" not in text.split("InMemoryRelation")[0], name
        assert rows(parts["shape"]) == rows(profile.shape(gappy))
        assert sorted(map(str, rows(parts["statistics"]))) == sorted(map(str, rows(profile.describe_text(gappy))))
    finally:
        parts["columns"].unpersist()


def test_clean(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, None), (2, "b")], "n int, s string")
    assert sorted(rows(clean.clean(frame))) == [(1, "a"), (2, "b")]
    assert clean.drop_repeats(frame).count() == 4
    assert clean.drop_incomplete(frame).count() == 3
