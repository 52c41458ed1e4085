import datetime
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from conftest import rows
from tillsight.operators import adaptive as ad
from tillsight.operators.roles import classify
from tillsight.plans.analysis import analyze, analyze_path
from tillsight.plans.holding import PLAN
from tillsight.sources.readers import scan_csv
from tillsight.sources.reuse import DatasetReuse


@pytest.fixture(scope="module")
def card_edges(spark):
    """Text columns with 1, 2, 40, 41 and 1 + null values."""
    return spark.range(820).select(
        F.lit("x").alias("c1"),
        (F.col("id") % 2).cast("string").alias("c2"),
        (F.col("id") % 40).cast("string").alias("c40"),
        (F.col("id") % 41).cast("string").alias("c41"),
        F.when(F.col("id") % 2 == 0, "y").alias("c2n"),
        (F.col("id") % 3).cast("string").alias("sixth"),
    )


def test_filter_candidates(card_edges):
    found = ad.filter_candidates(card_edges, classify(card_edges))
    assert sorted(rows(found)) == [(1, "c2", 2), (2, "c40", 40), (4, "c2n", 2)]


def test_filter_values(card_edges):
    found = rows(ad.filter_values(card_edges, classify(card_edges)))
    assert [v for _, c, v in found if c == "c2"] == ["0", "1"]
    assert [v for _, c, v in found if c == "c40"] == sorted(str(i) for i in range(40))
    assert [v for _, c, v in found if c == "c2n"] == ["y"]


def test_at_most_three_filters(spark):
    frame = spark.createDataFrame([tuple("abcd"), tuple("efgh")], "a string, b string, c string, d string")
    assert [c for _, c, _ in sorted(rows(ad.filter_candidates(frame, classify(frame))))] == ["a", "b", "c"]


def test_no_filter_without_text(spark):
    frame = spark.range(3)
    assert ad.filter_candidates(frame, classify(frame)).count() == 0


def test_filter_columns_are_decided_exactly_in_one_pass(spark):
    """Values spread over tasks in every way: too many in one task, in all together, or not."""
    frame = spark.range(6000).repartition(7).select(
        F.concat(F.lit("a"), F.col("id") % 40).alias("forty"),
        F.concat(F.lit("a"), F.col("id") % 41).alias("forty_one"),
        F.when(F.col("id") % 40 > 0, F.concat(F.lit("b"), F.col("id") % 40)).alias("with_null"),
        F.col("id").cast("string").alias("unique"),
        F.concat(F.lit("c"), F.spark_partition_id(), F.lit("-"), F.col("id") % 30).alias("few_per_task"),
    )
    roles = classify(frame)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("choices", "")
    try:
        candidates, values = ad.filter_candidates(frame, roles), ad.filter_values(frame, roles)
        assert list(tracker.getJobIdsForGroup("choices")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(rows(candidates)) == [(0, "forty", 40), (2, "with_null", 40)]
    found = rows(values)
    assert len(found) == 40 + 39
    assert {v for _, c, v in found if c == "forty"} == {f"a{i}" for i in range(40)}
    wide = ad.Limits(filter_most=300)
    assert {r[1] for r in rows(ad.filter_candidates(frame, roles, wide))} == {"forty", "forty_one", "with_null"}
    handed = ad.column_values(frame, roles).groupBy("column").count().collect()
    assert {r[0]: r[1] > 40 for r in handed} == {
        "forty": False, "forty_one": True, "with_null": False, "unique": True, "few_per_task": True,
    }


def online(spark):
    """Shaped like a web shop export: an id comes first, three small categories."""
    kinds, regions, pays = ["Books", "Games", "Toys"], ["Asia", "Europe"], ["Card", "Cash"]
    data = [
        (
            10001 + i,
            datetime.date(2024, 1 + i % 8, 1 + i % 28),
            kinds[i % 3],
            f"Item {i}",
            1 + i % 4,
            float(10 + i),
            regions[i % 2],
            pays[i % 2],
        )
        for i in range(96)
    ]
    return spark.createDataFrame(
        data,
        "`Transaction ID` int, Date date, `Product Category` string, `Product Name` string, "
        "`Units Sold` int, `Unit Price` double, Region string, `Payment Method` string",
    )


def grocery(spark):
    """Shaped like a monthly ledger of five years with one category."""
    data = [
        (datetime.date(2020 + i // 12, 1 + i % 12, 1), 100.0 + i, 10.0, i, "None" if i % 2 else "Feast")
        for i in range(60)
    ]
    return spark.createDataFrame(
        data,
        "Date date, Sales_Amount double, Marketing_Spend double, Active_Customers int, "
        "Seasonal_Event string",
    )


def test_analysis_of_a_web_shop(spark):
    with analyze(online(spark)) as analysis:
        assert analysis.roles.primary == "Transaction ID"
        assert [c for _, c, _ in sorted(rows(analysis.filter_candidates()))] == [
            "Product Category", "Region", "Payment Method",
        ]
        cards = rows(analysis.kpis())
        assert [c[2] for c in cards] == [
            "Total Transaction ID", "Total Units Sold", "Total Unit Price",
        ]
        assert cards[1][4] == "240" and cards[2][4] == "5,520.00"
        charts = rows(analysis.charts())
        kinds = {(c[0], c[1], c[2]) for c in charts}
        assert kinds == {
            ("chart_0", "Transaction ID Trend Over Time", "line"),
            ("chart_1", "Top Product Category by Transaction ID", "bar"),
            ("chart_2", "Distribution by Product Name", "doughnut"),
            ("chart_3", "Distribution by Region", "pie"),
        }
        assert len([c for c in charts if c[2] == "line"]) == 8
        assert len([c for c in charts if c[2] == "doughnut"]) == 10
        assert rows(analysis.shape()) == [(96, 8, "96 rows × 8 columns")]
        assert [r[0] for r in rows(analysis.preview())] == list(range(10096, 10086, -1))
        titles = [r[1] for r in rows(analysis.insights())]
        assert titles == ["Top Product Category", "Avg Transaction ID", "Peak Transaction ID"]
        assert [r[0] for r in rows(analysis.top_items())] == [1, 2, 3]
        assert analysis.forecast().count() == 1


def test_documents_of_an_analysis(spark):
    with analyze(online(spark), {"Region": "Asia"}) as analysis:
        found = {}
        for section, text in rows(analysis.documents()):
            found.setdefault(section, []).append(json.loads(text))
    assert found["shape"] == [{"shape": "48 rows × 8 columns"}]
    assert {c["chart_id"] for c in found["charts"]} == {f"chart_{i}" for i in range(4)}
    assert {f["column"] for f in found["filters"]} == {"Product Category", "Region", "Payment Method"}
    assert len(found["preview"]) == 10 and found["preview"][0]["Region"] == "Asia"
    assert found["forecast"][0]["accuracy"].endswith("%")


def test_analysis_of_a_path(spark, tmp_path):
    (tmp_path / "up.csv").write_text("kind,v\na,1\nb,2\nb,4\n")
    reuse = DatasetReuse(spark, scan_csv)
    with analyze_path(reuse, str(tmp_path / "up.csv"), {"kind": "b"}) as analysis:
        assert rows(analysis.kpis()) == [(0, "kpi_0", "Total v", 6.0, "6")]
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        analyze_path(reuse, str(tmp_path / "none.csv"))
    reuse.clear()


def test_analysis_of_a_ledger_keeps_the_oldest_periods(spark):
    with analyze(grocery(spark)) as analysis:
        charts = rows(analysis.charts())
        assert {c[2] for c in charts} == {"line", "bar"}
        trend = [c[4] for c in charts if c[2] == "line"]
        assert (trend[0], trend[-1], len(trend)) == ("2020-01", "2022-12", 36)
        forecast = analysis.forecast().first()
        assert forecast["label"] == "Next Period Sales_Amount"
        # the chart is cut, the forecast is not: 60 rising months go on rising
        assert forecast["value"] > 159
    with analyze(grocery(spark), keep="latest") as analysis:
        trend = [c[4] for c in rows(analysis.charts()) if c[2] == "line"]
        assert (trend[0], trend[-1]) == ("2022-01", "2024-12")


def test_limits_are_arguments(spark):
    frame = grocery(spark)
    limits = ad.Limits(periods=None, top_groups=1, preview_rows=3)
    with analyze(frame, limits=limits) as analysis:
        charts = rows(analysis.charts())
        assert len([c for c in charts if c[2] == "line"]) == 60
        assert len([c for c in charts if c[2] == "bar"]) == 1
        assert analysis.preview().count() == 3 and analysis.top_items().count() == 1
    roles = classify(frame)
    assert ad.dyn_trend(frame, roles, limit=None).count() == 60
    assert ad.dyn_forecast(frame, roles, limit=36).first()["value"] == pytest.approx(136.0, abs=1.0)


def test_columns_may_have_the_names_of_the_cells(spark):
    frame = spark.createDataFrame(
        [(1.0, 5, "x", "p"), (2.0, 6, "y", "p")], "key_first double, total int, section string, label string"
    )
    with analyze(frame) as analysis:
        assert [r[2:4] for r in rows(analysis.kpis())] == [("Total key_first", 3.0), ("Total total", 11.0)]
        assert {r[4] for r in rows(analysis.charts())} == {"x", "y", "p"}


@pytest.mark.parametrize("filters", [None, {"Region": "Asia"}, {"Units Sold": "2"}])
def test_one_pass_equals_single_sections(spark, filters):
    from tillsight.operators.filters import filter_columns

    frame = online(spark)
    roles = classify(frame, "Unit Price")
    single = filter_columns(frame, filters)
    with analyze(frame, filters, primary="Unit Price") as analysis:
        assert rows(analysis.kpis()) == rows(ad.dyn_kpis(single, roles))
        assert rows(analysis.charts()) == rows(ad.dyn_charts(single, roles))
        assert rows(analysis.top_items()) == rows(ad.top_items(single, roles))
        assert rows(analysis.insights()) == rows(ad.dyn_insights(single, roles))
        assert rows(analysis.forecast()) == rows(ad.dyn_forecast(single, roles))


def test_document_holds_all_sections(spark):
    frame = online(spark)
    with analyze(frame, {"Region": "Asia"}, primary="Revenue" if "Revenue" in frame.columns else None) as analysis:
        found = json.loads(analysis.document().first()["json"])
        charts = rows(analysis.charts())
        kpis, insights = rows(analysis.kpis()), rows(analysis.insights())
        values = rows(analysis.filter_values())
        preview = analysis.preview().collect()
    assert list(found) == [
        "shape", "columns", "filters", "kpis", "charts", "top_items", "forecast", "insights", "preview",
    ]
    assert found["columns"]["all"] == frame.columns
    for chart in found["charts"]:
        points = sorted(c[3:] for c in charts if c[0] == chart["id"])
        assert chart["labels"] == [p[1] for p in points]
        assert chart["values"] == pytest.approx([p[2] for p in points], abs=0.006)
    assert [c["id"] for c in found["charts"]] == sorted({c[0] for c in charts})
    assert [k["title"] for k in found["kpis"]] == [k[2] for k in kpis]
    assert [i["value"] for i in found["insights"]] == [i[2] for i in insights]
    assert {c["column"]: c["values"] for c in found["filters"]} == {
        c: [v for _, k, v in values if k == c] for c in dict.fromkeys(v[1] for v in values)
    }
    assert [sorted(r) for r in found["preview"]] == [sorted(k for k in r.asDict() if r[k] is not None) for r in preview]


def test_document_of_tables_without_some_roles(spark):
    empty = json.loads(analyze(online(spark), {"Region": "Nowhere"}, hold=PLAN).document().first()["json"])
    assert empty["shape"]["rows"] == 0 and empty["charts"] == [] and empty["preview"] == []
    assert empty["forecast"] is None and empty["filters"]
    texts = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "y")], "k string, `m.n` string")
    found = json.loads(analyze(texts, hold=PLAN).document().first()["json"])
    assert found["top_items"] is None and found["forecast"] is None
    assert found["charts"][0]["values"] == [2, 1] and len(found["preview"]) == 3


def test_boosted_trees_as_a_third_candidate(spark):
    with analyze(grocery(spark), boosted=True) as analysis:
        forecast = analysis.forecast().first()
    # a straight line: the linear candidates fit it exactly, trees do not
    assert forecast["value"] == pytest.approx(160.0, abs=1.0)
    assert forecast["accuracy"] == "99.0%"


def test_analysis_of_no_rows(spark):
    with analyze(online(spark), {"Region": "Nowhere"}) as analysis:
        assert rows(analysis.kpis()) == [(0, "kpi_0", "Total Records", 0.0, "0")]
        assert analysis.charts().count() == 0
        assert analysis.forecast().count() == 0
        assert [r[2] for r in rows(analysis.insights())] == ["N/A", "N/A"]
        assert rows(analysis.shape()) == [(0, 8, "0 rows × 8 columns")]


def test_analysis_without_numbers_or_dates(spark):
    frame = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "y")], "k string, m string")
    with analyze(frame) as analysis:
        assert rows(analysis.kpis()) == [(0, "kpi_0", "Total Records", 3.0, "3")]
        assert [c[1] for c in rows(analysis.charts())] == ["Distribution by m"] * 2
        assert analysis.top_items() is None and analysis.forecast() is None
        assert rows(analysis.insights()) == [
            (0, "Top k", "a", "Highest frequency — 2 records")
        ]
        assert analysis.preview().count() == 3


def test_analysis_of_numbers_only(spark):
    with analyze(spark.range(5)) as analysis:
        assert rows(analysis.kpis()) == [(0, "kpi_0", "Total id", 10.0, "10")]
        assert analysis.charts() is None
        assert [r[1:3] for r in rows(analysis.insights())] == [("Avg id", "2.00"), ("Peak id", "4")]


def test_null_period_is_charted_first_and_not_forecast(spark):
    frame = spark.sql(
        """select * from values (date'2024-01-01', 1.0D), (date'2024-02-01', 2.0D),
        (cast(null as date), 9.0D) as t(day, v)"""
    )
    roles = classify(frame)
    assert rows(ad.dyn_trend(frame, roles)) == [(1, "None", 9.0), (2, "2024-01", 1.0), (3, "2024-02", 2.0)]
    assert ad.series_of(ad.by_period(frame, roles)).count() == 2


def test_null_group_can_be_the_most_frequent(spark):
    frame = spark.createDataFrame([(None,), (None,), ("a",)], "k string")
    assert rows(ad.dyn_insights(frame, classify(frame))) == [
        (0, "Top k", "None", "Highest frequency — 2 records")
    ]


def test_cards_of_columns_without_values_are_left_out(spark):
    frame = spark.createDataFrame([(None, 2), (None, 3)], "a double, b int")
    assert rows(ad.dyn_kpis(frame, classify(frame))) == [(1, "kpi_1", "Total b", 5.0, "5")]


def test_sums_of_whole_numbers_do_not_overflow(spark):
    frame = spark.createDataFrame([(2**62,), (2**62,), (2**62,)], "v bigint")
    assert rows(ad.dyn_kpis(frame, classify(frame)))[0][4] == f"{3 * 2**62:,}"


def test_ties_at_the_edge_of_a_top_list(spark):
    frame = spark.createDataFrame([(f"k{i:02d}", 1.0) for i in range(12)], "k string, v double")
    roles = classify(frame)
    expected = [f"k{i:02d}" for i in range(10)]
    assert [r[1] for r in rows(ad.dyn_top_category(frame, roles))] == expected
    assert [r[1] for r in rows(ad.top_items(frame, roles))] == expected


def test_preview_without_numbers_or_with_odd_names(spark):
    frame = spark.createDataFrame([(i, str(i)) for i in range(30)], "`a.b` int, `c d` string")
    assert [r[0] for r in rows(ad.preview(frame, classify(frame)))] == list(range(29, 19, -1))
    assert ad.preview(frame.select("`c d`"), classify(frame.select("`c d`"))).count() == 10
