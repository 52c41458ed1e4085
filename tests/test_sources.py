import os
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from conftest import SALES_ROWS, SALES_SCHEMA, day, rows
from tillsight.functions import dates
from tillsight.operators.filters import filter_sales
from tillsight.operators.roles import classify
from tillsight.sources.readers import scan, scan_csv
from tillsight.sources.refresh import FileTotals
from tillsight.sources.reuse import DatasetReuse
from tillsight.sources.sales import land_sales, observed_sales, read_sales, rejects, type_sales, undated
from tillsight.sources.shared import shared_folder
from tillsight.sources.star import sales_totals, sales_view

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("01/05/2016", "2016-01-05"),
        ("1/5/2016", "2016-01-05"),
        ("11-08-2016", "2016-11-08"),
        ("1-8-2016", "2016-01-08"),
        (" 1/5/2016 ", "2016-01-05"),
        ("13/25/2016", None),
        ("2/30/2016", None),
        ("2016-01-05", None),
        ("1/5/2016 10:00", None),
        ("11-08-2016x", None),
        ("01/05/16", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_date(spark, text, expected):
    frame = spark.createDataFrame([(text,)], "d string").select(dates.parse_date(F.col("d")))
    assert frame.first()[0] == (day(expected) if expected else None)


def test_sales_are_typed(sales):
    assert dict(sales.dtypes)["Order Date"] == "date"
    assert dict(sales.dtypes)["Sales"] == "double"
    assert rows(sales.select("Order Date", "Month", "Year", "month_num", "Sales", "Discount")) == [
        (day("2016-01-05"), "Jan", 2016, 1, 100.5, 0.1),
        (day("2016-01-06"), "Jan", 2016, 1, 200.0, 0.2),
        (None, None, None, None, 50.0, None),
        (day("2017-12-31"), "Dec", 2017, 12, None, 0.0),
        (day("2017-12-01"), "Dec", 2017, 12, 300.25, None),
        (None, None, None, None, None, None),
    ]
    assert undated(sales).first()[0] == 2


@pytest.fixture
def csv_folder(spark, tmp_path):
    folder = tmp_path / "landing"
    spark.createDataFrame(SALES_ROWS, SALES_SCHEMA).coalesce(1).write.option("header", True).csv(
        str(folder)
    )
    (folder / "notes.txt").write_text("not,a,sales,file\n")
    return str(folder)


@pytest.mark.parametrize("infer", [True, False])
def test_read_sales_from_a_folder_takes_csv_only(spark, csv_folder, sales, infer):
    read = read_sales(spark, csv_folder, infer=infer)
    columns = ["Order Date", "Month", "Year", "Sales", "Profit", "Discount"]
    assert sorted(map(str, rows(read.select(columns)))) == sorted(map(str, rows(sales.select(columns))))


def test_csv_schema_is_checked_against_the_header(spark, csv_folder):
    assert scan_csv(spark, csv_folder, SALES_SCHEMA).count() == len(SALES_ROWS)
    swapped = SALES_SCHEMA.replace("Region string, Category", "Category string, Region")
    with pytest.raises(Exception, match="CSV header does not conform"):
        scan_csv(spark, csv_folder, swapped).collect()


def test_scan_tells_parquet_from_csv(spark, csv_folder):
    assert scan(spark, f"{ROOT}/region.parquet").count() == 5
    assert scan(spark, csv_folder).count() == len(SALES_ROWS)


def test_inferred_dates_and_their_roles(spark, tmp_path):
    file = tmp_path / "dates.csv"
    file.write_text(
        "Date,ordered_on,slash_day,slash_on\n2024-01-05,2024-01-05,1/5/2024,1/5/2024\n"
    )
    frame = scan_csv(spark, str(file))
    assert dict(frame.dtypes) == {
        "Date": "date",
        "ordered_on": "date",
        "slash_day": "string",
        "slash_on": "string",
    }
    roles = classify(frame)
    assert roles.date == ("Date", "ordered_on", "slash_day")
    assert roles.categorical == ("slash_on",)


def test_landed_sales_prune_by_year(spark, sales, tmp_path):
    path = str(tmp_path / "landed.parquet")
    land_sales(sales, path)
    landed = scan(spark, path)
    kept = filter_sales(landed, year="2017")
    assert kept.count() == 2
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Year" in plan


def test_shared_folder_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    assert folder != shared_folder(spark)
    if base:
        assert folder.startswith(base)


def write_csv(path, text):
    path.write_text(text)
    return str(path)


def test_reuse_reads_again_only_after_a_change(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", "k,v\na,1\n")
    kept = DatasetReuse(spark, scan_csv)
    assert kept.preload(path)
    first = kept.load(path)
    assert first.is_cached and kept.load(path) is first
    time.sleep(0.01)
    write_csv(tmp_path / "a.csv", "k,v\na,1\nb,2\n")
    os.utime(path, (time.time() + 5, time.time() + 5))
    again = kept.load(path)
    assert again is not first and again.count() == 2
    assert not first.is_cached
    kept.clear(path)
    assert not again.is_cached
    kept.clear()


def test_reuse_keeps_the_columns_asked_for_or_nothing(spark, tmp_path):
    path = write_csv(tmp_path / "c.csv", "k,v\na,1\n")
    kept = DatasetReuse(spark, scan_csv)
    narrow = kept.load(path, columns=("v",))
    assert narrow.columns == ["v"] and narrow.is_cached and kept.load(path, columns=("v",)) is narrow
    whole = kept.load(path)
    assert whole.columns == ["k", "v"] and not narrow.is_cached
    fresh = kept.load(path, use_cache=False)
    assert not fresh.is_cached and not whole.is_cached and fresh.count() == 1


def test_preload_of_nothing(spark, tmp_path):
    assert not DatasetReuse(spark, scan_csv).preload(str(tmp_path / "missing.csv"))


def test_a_released_derived_frame_leaves_the_kept_one(spark, tmp_path):
    from tillsight.plans.analysis import analyze

    path = write_csv(tmp_path / "b.csv", "kind,v\na,1\nb,2\n")
    kept = DatasetReuse(spark, scan_csv)
    base = kept.load(path)
    with analyze(base, {"no_such": "x"}) as analysis:
        assert analysis.kpis().count() == 1
    assert base.is_cached and base.storageLevel.useMemory
    kept.clear()


def test_sales_view_joins_only_what_it_needs(spark):
    def tables(frame):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        return {t for t in ("c_custkey", "o_orderkey", "p_partkey", "r_regionkey") if t in plan}

    assert tables(sales_view(spark, ROOT, ("Sales",))) == set()
    assert tables(sales_view(spark, ROOT, ("Year",))) == {"o_orderkey"}
    assert tables(sales_view(spark, ROOT, ("Segment",))) == {"o_orderkey", "c_custkey"}
    assert tables(sales_view(spark, ROOT, ("Category",))) == {"p_partkey"}
    assert tables(sales_view(spark, ROOT)) == {"c_custkey", "o_orderkey", "p_partkey", "r_regionkey"}


def test_sales_totals_do_not_mix_orders_and_parts(spark):
    with pytest.raises(ValueError):
        sales_totals(spark, ROOT, ("Region", "Category", "Sales"))


def test_totals_of_everything_are_one_row(spark):
    assert sales_totals(spark, ROOT, ("Sales", "orders")).count() == 1


def raw_sales(spark):
    rows = [
        ("1/5/2016", "10.5", "1", "0.1"), ("2/30/2016", "x", "", None), ("", " ", "2", "5%"),
        (None, None, "n/a", "0"), ("12-31-2016", "1e3", "-4", "0.2"),
    ]
    return spark.createDataFrame(rows, "`Order Date` string, Sales string, Profit string, Discount string")


WANT = {
    "rows": 5, "missing_dates": 2, "bad_dates": 1, "undated_rows": 3, "missing_sales": 2, "bad_sales": 1,
    "missing_profit": 1, "bad_profit": 1, "missing_discount": 1, "bad_discount": 1,
}


def test_rejected_values_are_counted_in_the_pass_that_types_them(spark, tmp_path):
    raw = raw_sales(spark)
    assert rejects(raw).first().asDict() == WANT
    observation = Observation("ingest")
    typed = observed_sales(raw, observation)
    spark.sparkContext.setJobGroup("ingest", "")
    try:
        typed.write.parquet(str(tmp_path / "typed"))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("ingest")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert observation.get == WANT and len(jobs) == 1
    assert spark.read.parquet(str(tmp_path / "typed")).exceptAll(type_sales(raw)).count() == 0
    assert undated(typed).first()[0] == WANT["undated_rows"]
    empty = Observation("none")
    assert observed_sales(raw.where("false"), empty).count() == 0
    assert set(empty.get.values()) == {0}


def totals_of(spark, tmp_path, read):
    def reader(session, files):
        read.append(sorted(os.path.basename(f) for f in files))
        return session.read.option("header", True).schema("k string, v double").csv(files)

    return FileTotals(spark, reader, ["k"], ["v"], str(tmp_path / "kept"))


def test_only_changed_files_are_read_again(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    read = []
    totals = totals_of(spark, tmp_path, read)
    with pytest.raises(ValueError):
        totals.totals()
    write_csv(tmp_path / "in" / "a b.csv", "k,v\nx,1\ny,2\n")
    write_csv(tmp_path / "in" / "deep" / "b.csv", "k,v\nx,10\n,5\n")
    assert len(totals.refresh(str(tmp_path / "in"))) == 2
    assert set(rows(totals.totals())) == {("x", 11.0, 2), ("y", 2.0, 1), (None, 5.0, 1)}
    assert totals.refresh(str(tmp_path / "in")) == [] and totals.version() == 1
    # one file changes, one comes, none is read twice
    write_csv(tmp_path / "in" / "a b.csv", "k,v\nx,100\n")
    write_csv(tmp_path / "in" / "c.csv", "k,v\nz,7\n")
    totals.refresh(str(tmp_path / "in"))
    assert read == [["a b.csv", "b.csv"], ["a b.csv", "c.csv"]]
    assert set(rows(totals.totals())) == {("x", 110.0, 2), (None, 5.0, 1), ("z", 7.0, 1)}
    # a file goes: nothing is read
    os.remove(tmp_path / "in" / "deep" / "b.csv")
    assert totals.refresh(str(tmp_path / "in")) == [] and totals.version() == 3
    assert set(rows(totals_of(spark, tmp_path, read).totals())) == {("x", 100.0, 1), ("z", 7.0, 1)}
    assert len(read) == 2


def test_a_failed_refresh_changes_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_csv(tmp_path / "in" / "a.csv", "k,v\nx,1\n")
    totals = totals_of(spark, tmp_path, [])
    totals.refresh(str(tmp_path / "in"))
    write_csv(tmp_path / "in" / "b.csv", "k,v\nx,5\n")

    def broken(session, files):
        return session.read.option("header", True).schema("k string, w double").csv(files)

    with pytest.raises(AnalysisException):
        FileTotals(spark, broken, ["k"], ["v"], str(tmp_path / "kept")).refresh(str(tmp_path / "in"))
    assert rows(totals.totals()) == [("x", 1.0, 1)] and totals.version() == 1
    totals.refresh(str(tmp_path / "in"))
    assert rows(totals.totals()) == [("x", 6.0, 2)]
