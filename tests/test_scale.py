"""Shape of the physical plans: what is read, shuffled, split and kept off the driver."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillsight import catalog
from tillsight.operators import breakdowns as bd
from tillsight.operators.filters import filter_sales
from tillsight.plans.analysis import analyze
from tillsight.plans.dashboard import Dashboard
from tillsight.plans.holding import NOT
from tillsight.plans.positions import spread_places
from tillsight.sources.star import sales_totals, sales_view

ROOT = "/root/testdata/sf0.001"
#: Trees are grown by numpy, and tasks pick the values of filter columns from Arrow batches.
ARROW = {
    "fc_gbt", "forecast_best_of_three", "dyn_forecast_of_three",
    "filter_candidates", "filter_values", "analysis_json",
}
#: Queries that write a table of their own and read it.
WRITERS = {
    "scan_csv", "dataset_reuse", "dataset_release", "month_model_saved", "refresh_by_file", "report_written",
}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def final_plan(frame):
    frame.collect()
    return plan(frame)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_cross_join_and_no_python_in_the_plan(spark, name):
    text = plan(catalog.queries()[name](spark, ROOT))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in ARROW:
        assert not re.search(r"Python|Pandas|Arrow", text)
    assert not re.search(r"BatchEvalPython|ExistingRDD", text)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - WRITERS))
def test_no_query_runs_a_job_while_it_is_planned(spark, name):
    """But for the footers of Parquet files, whose jobs read no rows."""
    context = spark.sparkContext
    context.setJobGroup(f"plan-{name}", "")
    try:
        catalog.queries()[name](spark, ROOT)
        for job in context.statusTracker().getJobIdsForGroup(f"plan-{name}"):
            stages = context.statusTracker().getJobInfo(job).stageIds
            names = [context.statusTracker().getStageInfo(s).name for s in stages]
            assert all(n.startswith("parquet at") for n in names), names
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", ["dataset_reuse", "dyn_charts", "dashboard_json", "report_summary", "forecast_overlay"])
def test_no_query_leaves_anything_in_memory(spark, name):
    kept = spark.sparkContext._jsc.getPersistentRDDs
    before = set(kept().keySet())
    catalog.queries()[name](spark, ROOT).collect()
    assert set(kept().keySet()) <= before


def relations(frame, column):
    """How often the rows with that column are read, apart from what is held in memory."""
    text = frame._jdf.queryExecution().withCachedData().toString()
    return len(re.findall(rf"Relation \[[^\]]*\b{column}#", text))


@pytest.mark.parametrize("name, scans", [("dyn_charts", 1), ("report_trends", 2)])
def test_sections_of_one_select_read_the_lines_once_per_side(spark, name, scans):
    frame = catalog.queries()[name](spark, ROOT)
    assert relations(frame, "l_extendedprice") == scans
    assert plan(frame).count("Generate inline") == scans


@pytest.mark.parametrize(
    "name, passes",
    [
        ("dashboard_json", 2),  # a pass for each side of the star schema
        # the choice of years in a filtered dashboard is that of all sales
        ("dashboard_filtered_json", 2),
        ("report_summary", 1),
        ("report_breakdown", 1),
        ("forecast_overlay", 1),
        # the choices of the filters are a pass of their own; the preview reads the joined lines
        ("analysis_json", 2),
    ],
)
def test_sections_of_one_plan_share_the_pass_over_the_lines(spark, name, passes):
    text = final_plan(catalog.queries()[name](spark, ROOT))
    ran = text.split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet.*lineitem\.parquet", ran)) == passes
    assert "ReusedExchange" in ran


def test_every_section_of_a_dashboard_hits_the_held_cells(spark):
    with Dashboard(sales_view(spark, ROOT)) as board:
        documents = board.documents()
        assert relations(documents, "l_extendedprice") == 0
        text = documents._jdf.queryExecution().withCachedData().toString()
        assert text.count("InMemoryRelation") >= 9
        assert "WindowGroupLimit" in plan(board.cells.groupBy().count()) or "WindowGroupLimit" in text


def test_every_section_of_an_analysis_hits_the_held_cells(spark):
    columns = ("Order Date", "Sales", "Region", "Category", "Segment")
    with analyze(sales_view(spark, ROOT, columns)) as analysis:
        documents = analysis.documents()
        # the choices of the filters and the preview are passes of their own
        assert relations(documents, "l_extendedprice") <= 2
        charts, insights = analysis.charts(), analysis.insights()
        assert relations(charts, "l_extendedprice") == relations(insights, "l_extendedprice") == 0
        assert relations(analysis.shape(), "l_extendedprice") == 0


def test_positions_of_a_long_list_come_from_many_tasks(spark):
    long = spark.range(0, 20_000).select(
        F.when(F.col("id") % 4 == 0, "short").otherwise("long").alias("section"),
        F.concat(F.lit("g"), F.col("id")).alias("label"),
        (F.col("id") * 7919 % 5003).cast("double").alias("total"),
    )
    placed = spread_places(long, "section", "total", "label")
    order = Window.partitionBy("section").orderBy(F.desc("total"), F.asc("label"))
    want = long.withColumn("pos", F.row_number().over(order))
    assert placed.exceptAll(want.withColumn("pos", F.col("pos").cast("bigint"))).count() == 0
    assert placed.count() == 20_000
    numbered = re.findall(r"row_number\(\) windowspecdefinition\((\w+)#\d+, (\w+)#", plan(placed))
    assert set(numbered) == {("section", "range")}


def test_tasks_hand_on_the_largest_groups_only(spark):
    texts = spark.read.parquet(f"{ROOT}/documents.parquet")
    cells = analyze(texts, hold=NOT).cells
    assert "WindowGroupLimit" in plan(cells)
    sizes = {r[0]: r[1] for r in cells.groupBy("section").count().collect()}
    assert all(n <= 10 for section, n in sizes.items() if section != "period")


def read_columns(text):
    return {
        file: set(re.findall(r"(\w+):", schema))
        for file, schema in re.findall(r"/(\w+)\.parquet.*?ReadSchema: struct<(.*?)>", text)
    }


def test_only_needed_columns_are_read(spark):
    text = plan(bd.sales_by(sales_totals(spark, ROOT, ("Category", "Sales")), "Category"))
    assert read_columns(text) == {
        "lineitem": {"l_orderkey", "l_partkey", "l_extendedprice", "l_discount"} - {"l_orderkey"},
        "part": {"p_partkey", "p_type"},
    }


def test_filters_reach_the_scans(spark):
    frame = filter_sales(sales_view(spark, ROOT), 1998, "EUROPE", "STANDARD")
    text = plan(bd.kpi_summary(frame))
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01T00:00)" in text
    assert "EqualTo(r_name,EUROPE)" in text
    assert "EqualTo(p_type,STANDARD)" in text


def test_keys_are_summed_before_the_join(spark):
    text = plan(bd.top_products(sales_totals(spark, ROOT, ("Product Name", "Sales", "Profit"))))
    lines = text.splitlines()
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    assert any("partial_sum" in line and "l_partkey" in line for line in lines[join:])
    assert "TakeOrderedAndProject" in text


@pytest.fixture
def merge_joins(spark):
    """Joins as on large tables: no side small enough to be sent to all tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key) for key in settings if key in dict(spark.conf.getAll)}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        if key in before:
            spark.conf.set(key, before[key])
        else:
            spark.conf.unset(key)


def hot_star(spark, tmp_path):
    """The small star schema with a third of all lines on one part and one order."""
    for name in ("orders", "customer", "nation", "region", "part"):
        spark.read.parquet(f"{ROOT}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    lines = spark.read.parquet(f"{ROOT}/lineitem.parquet")
    hot = F.col("l_linenumber") <= 2
    lines = lines.withColumns(
        {
            "l_partkey": F.when(hot, F.lit(7).cast("bigint")).otherwise(F.col("l_partkey")),
            "l_orderkey": F.when(hot, F.lit(11).cast("bigint")).otherwise(F.col("l_orderkey")),
        }
    )
    # several files, so that a hot key comes from more than one map task
    many = lines
    for _ in range(3):
        many = many.unionByName(lines)
    many.repartition(8).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def by_label(frame):
    return sorted((str(r[0]), str(r[1]), round(r["total_sales"], 2)) for r in frame.collect())


def test_hot_keys_are_split_in_the_one_pass_breakdown(spark, tmp_path, merge_joins):
    root = hot_star(spark, tmp_path)
    columns = ("Region", "Category", "Segment", "Month", "month_num", "Sales")
    frame = bd.breakdowns_one_pass(sales_view(spark, root, columns))
    text = final_plan(frame)
    assert "SortMergeJoin(skew=true)" in text or "skewed" in text
    split = by_label(frame)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plain = by_label(bd.breakdowns_one_pass(sales_view(spark, root, columns)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert split == plain


def test_hot_keys_collapse_before_the_shuffle(spark, tmp_path, merge_joins):
    root = hot_star(spark, tmp_path)
    totals = bd.sales_by(sales_totals(spark, root, ("Category", "Sales")), "Category")
    lines = bd.sales_by(sales_view(spark, root, ("Category", "Sales")), "Category")
    found = {r[0]: round(r[1], 2) for r in totals.collect()}
    assert found == {r[0]: round(r[1], 2) for r in lines.collect()}
    assert "skew=true" not in plan(totals)
