"""Analysis of any table: filters, totals, distributions, trend and insights by column role.

The sections are functions of grouped frames (``label``, ``total``, ``records``), so that a
single section can be asked for on its own and :mod:`tillsight.plans.analysis` can feed all
of them from one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.functions import dates
from tillsight.functions.columns import named, rows_from
from tillsight.functions.numbers import percent_text, thousands, trend_text, whole
from tillsight.operators import forecast as fc
from tillsight.operators.boosted import pick_of_three
from tillsight.operators.ranking import ranked_top
from tillsight.operators.roles import Roles


@dataclass(frozen=True)
class Limits:
    """How many columns, groups and periods a section looks at or lists.

    ``filter_scan`` text columns are looked at for filters, ``filter_kept`` kept, with
    ``filter_least`` to ``filter_most`` values; ``cards`` number columns have a total card;
    the trend chart shows ``periods`` (None: all), charts and top items ``top_groups``, the
    pie ``pie_groups``; the preview has ``preview_rows``. None of them cuts what a section
    is computed from.
    """

    filter_scan: int = 5
    filter_kept: int = 3
    filter_least: int = 2
    filter_most: int = 40
    cards: int = 4
    periods: int | None = 36
    top_groups: int = 10
    pie_groups: int = 8
    preview_rows: int = 10


LIMITS = Limits()

# Titles and texts of the sections; {} stands for a column name.
TREND_TITLE, TREND_CHART = "{} Trend Over Time", "line"
TOP_TITLE, TOP_CHART = "Top {} by {}", "bar"
SECOND_CHART, THIRD_CHART = "doughnut", "pie"
DISTRIBUTION_TITLE = "Distribution by {}"
TOTAL_TITLE = "Total {}"
RECORDS_TITLE = "Total Records"
MODE_TITLE, MODE_TEXT = "Top {}", "Highest frequency — %s records"
MEAN_TITLE, MEAN_TEXT = "Avg {}", "Dataset average across all records"
PEAK_TITLE, PEAK_TEXT = "Peak {}", "Maximum single value in dataset"
FORECAST_TITLE = "Next Period {}"
NULL_LABEL = "None"

# Filters -----------------------------------------------------------------------------


def _few_values(columns: int, most: int):
    """Distinct values of each column of a task's rows; of more than ``most`` one more than that.

    A column that has shown too many values is not looked at again.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict] = [{} for _ in range(columns)]
        for batch in batches:
            for values, column in zip(found, batch.columns):
                if len(values) <= most:
                    values.update(dict.fromkeys(pc.unique(column).slice(0, most + 1).to_pylist()))
        rows = [(i, value) for i, values in enumerate(found) for value in [*values][: most + 1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())],
            ["ordinal", "value"],
        )

    return find


def column_values(frame: DataFrame, roles: Roles, limits: Limits = LIMITS) -> DataFrame:
    """Distinct values, null included, of the text columns that may become filters.

    One pass, in which every task hands on at most ``filter_most + 1`` values of a column. A
    column with no more values than that hands on all of them. One with more is left with more
    than ``filter_most`` and so is known to be too wide, though not by which values.
    """
    columns = list(roles.categorical[: limits.filter_scan])
    if not columns:
        return frame.sparkSession.createDataFrame([], "ordinal int, column string, value string")
    texts = [named(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]
    few = frame.select(*texts).mapInArrow(
        _few_values(len(columns), limits.filter_most), "ordinal int, value string"
    )
    name = F.array(*[F.lit(c) for c in columns])
    return few.distinct().select("ordinal", F.get(name, F.col("ordinal")).alias("column"), "value")


def _of_candidates(values: DataFrame, limits: Limits) -> DataFrame:
    """Values of the first columns with few enough of them; null counts as a value."""
    counted = values.withColumn("n_distinct", F.count(F.lit(1)).over(Window.partitionBy("column")))
    fitting = counted.where(F.col("n_distinct").between(limits.filter_least, limits.filter_most))
    place = F.dense_rank().over(Window.orderBy("ordinal"))
    return fitting.withColumn("place", place).where(F.col("place") <= limits.filter_kept)


def filter_candidates(frame: DataFrame, roles: Roles, limits: Limits = LIMITS) -> DataFrame:
    """The filter columns with their number of values."""
    found = _of_candidates(column_values(frame, roles, limits), limits)
    return found.groupBy("ordinal", "column").agg(F.max("n_distinct").alias("n_distinct"))


def filter_values(frame: DataFrame, roles: Roles, limits: Limits = LIMITS) -> DataFrame:
    """The values to choose from in each filter column, sorted."""
    return (
        _of_candidates(column_values(frame, roles, limits), limits)
        .where(F.col("value").isNotNull())
        .select("ordinal", "column", "value")
        .orderBy("ordinal", "value")
    )


# Sums --------------------------------------------------------------------------------


def exact_sum(name: str, dtype: T.DataType) -> Column:
    """Sum that cannot overflow: whole numbers are added as decimals."""
    value = named(name)
    if isinstance(dtype, T.IntegralType):
        return F.sum(value.cast("decimal(20,0)"))
    return F.sum(value)


# Grouped frames ------------------------------------------------------------------------


def by_period(
    frame: DataFrame, roles: Roles, raw_text_period: bool = False
) -> DataFrame:
    """Sum of the primary number per period: (label, total)."""
    day, dtype = roles.date[0], roles.type_of(roles.date[0])
    return (
        frame.groupBy(dates.period_group(named(day), dtype, raw_text_period).alias("g"))
        .agg(exact_sum(roles.primary, roles.type_of(roles.primary)).alias("total"))
        .select(dates.period_text(F.col("g"), dtype).alias("label"), "total")
    )


def by_category(frame: DataFrame, roles: Roles, place: int = 0) -> DataFrame:
    """Rows and, where there is a number, its sum per value: (label, records, total)."""
    measures = [F.count(F.lit(1)).alias("records")]
    if roles.primary is not None:
        measures.append(exact_sum(roles.primary, roles.type_of(roles.primary)).alias("total"))
    return frame.groupBy(named(roles.categorical[place]).alias("label")).agg(*measures)


# Sections of grouped frames --------------------------------------------------------------


def first_periods(periods: DataFrame, keep: str = "oldest", limit: int | None = None):
    """The listed periods, all of them without a limit; a null period sorts first."""
    if limit is None:
        return periods.orderBy(F.asc_nulls_first("label"))
    if keep == "latest":
        periods = periods.orderBy(F.desc_nulls_last("label")).limit(limit)
    return periods.orderBy(F.asc_nulls_first("label")).limit(limit)


def _positioned(frame: DataFrame, *order: Column) -> DataFrame:
    """Number the rows of a frame that a limit has already made small."""
    return frame.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def _points(frame: DataFrame, value: Column, *order: Column) -> DataFrame:
    text = F.coalesce(F.col("label"), F.lit(NULL_LABEL))
    return _positioned(frame, *order).select(
        "pos", text.alias("label"), F.coalesce(value.cast("double"), F.lit(0.0)).alias("value")
    )


def trend_points(
    periods: DataFrame, keep: str = "oldest", limit: int | None = LIMITS.periods
) -> DataFrame:
    listed = first_periods(periods, keep, limit)
    return _points(listed, F.col("total"), F.asc_nulls_first("label"))


def top_points(groups: DataFrame, limit: int = LIMITS.top_groups) -> DataFrame:
    order = (F.desc("total"), F.asc("label"))
    return _points(groups.orderBy(*order).limit(limit), F.col("total"), *order)


def count_points(groups: DataFrame, limit: int) -> DataFrame:
    order = (F.desc("records"), F.asc("label"))
    return _points(groups.orderBy(*order).limit(limit), F.col("records"), *order)


def chart_specs(roles: Roles) -> list[tuple[str, str, str]]:
    """(section, title, type) of each chart the roles allow, in order."""
    specs = []
    if roles.date and roles.primary:
        specs.append(("trend", TREND_TITLE.format(roles.primary), TREND_CHART))
    if roles.categorical and roles.primary:
        title = TOP_TITLE.format(roles.categorical[0], roles.primary)
        specs.append(("top", title, TOP_CHART))
    for place, section, kind in ((1, "second", SECOND_CHART), (2, "third", THIRD_CHART)):
        if len(roles.categorical) > place:
            specs.append((section, DISTRIBUTION_TITLE.format(roles.categorical[place]), kind))
    return specs


def charts_from(cells: DataFrame, roles: Roles, keep: str, limits: Limits) -> DataFrame:
    """All charts in one select over the cells of an analysis, in long form.

    ``cells`` has ``section`` (period, first, second, third), ``label``, ``total`` and
    ``records``; sections are listed in the order that makes their chart.
    """
    source = {"trend": "period", "top": "first", "second": "second", "third": "third"}
    most = {
        "trend": limits.periods, "top": limits.top_groups,
        "second": limits.top_groups, "third": limits.pie_groups,
    }
    specs = list(enumerate(chart_specs(roles)))

    def by_section(values: dict) -> Column:
        return F.create_map(
            *[F.lit(x) for _, (s, _, _) in specs for x in (source[s], values[s])]
        )[F.col("section")]

    wanted = cells.where(F.col("section").isin([source[s] for _, (s, _, _) in specs]))
    summed = F.col("section").isin("period", "first")
    if roles.primary is None:
        value = F.col("records").cast("double")
    else:
        value = F.when(summed, F.col("total").cast("double")).otherwise(F.col("records"))
    each = Window.partitionBy("section")
    trend = F.col("section") == "period"
    order = each.orderBy(
        F.when(~trend, value).desc(),
        F.when(trend, F.col("label")).asc_nulls_first(),
        F.asc("label"),
    )
    place = F.row_number().over(order)
    limit = by_section({s: most[s] or 2**31 - 1 for _, (s, _, _) in specs})
    skipped = F.lit(0)
    if keep == "latest":
        # Of the trend, the last periods: those before them are left out.
        over = F.count(F.lit(1)).over(each) - limit
        skipped = F.when(trend, F.greatest(over, F.lit(0))).otherwise(F.lit(0))
    numbered = wanted.withColumn("pos", (place - skipped).cast("int"))
    return numbered.where((F.col("pos") >= 1) & (F.col("pos") <= limit)).select(
        by_section({s: f"chart_{i}" for i, (s, _, _) in specs}).alias("chart_id"),
        by_section({s: title for _, (s, title, _) in specs}).alias("title"),
        by_section({s: kind for _, (s, _, kind) in specs}).alias("type"),
        "pos",
        F.coalesce(F.col("label"), F.lit(NULL_LABEL)).alias("label"),
        F.coalesce(value, F.lit(0.0)).alias("value"),
    ).orderBy("chart_id", "pos")


def charts_of(roles: Roles, points: dict[str, DataFrame]) -> DataFrame:
    """All charts in long form: (chart_id, title, type, pos, label, value)."""
    frames = [
        points[section].select(
            F.lit(f"chart_{number}").alias("chart_id"),
            F.lit(title).alias("title"),
            F.lit(kind).alias("type"),
            "pos",
            "label",
            "value",
        )
        for number, (section, title, kind) in enumerate(chart_specs(roles))
    ]
    charts = frames[0]
    for frame in frames[1:]:
        charts = charts.unionByName(frame)
    return charts


def top_items_of(groups: DataFrame, roles: Roles, limit: int = LIMITS.top_groups) -> DataFrame:
    """Ranked table of the leading category: rank, label, value text, value, share."""
    text = _sum_text(F.col("total"), roles.type_of(roles.primary))
    totals = groups.select(
        "label", F.col("total").cast("double").alias("value"), text.alias("value_text")
    )
    ranked = ranked_top(totals, "label", "value", limit, carry=("value_text",))
    return ranked.withColumn("label", F.coalesce(F.col("label"), F.lit(NULL_LABEL)))


def mode_of(groups: DataFrame) -> DataFrame:
    """The most frequent value with its count; null can win."""
    return groups.orderBy(F.desc("records"), F.asc("label")).limit(1).select("label", "records")


def series_of(periods: DataFrame, keep: str = "oldest", limit: int | None = None) -> DataFrame:
    """Month series of the periods that have a name and a sum.

    The whole series, unless the caller asks for ``limit`` periods.
    """
    listed = first_periods(periods, keep, limit).where(
        F.col("label").isNotNull() & F.col("total").isNotNull()
    )
    place = F.row_number().over(Window.orderBy("label")) - 1
    return listed.select(
        F.col("label").alias("period"), F.col("total").cast("double").alias("y"), place.alias("i")
    ).select("period", "y", dates.period_month(F.col("period"), F.col("i")).alias("month_num"))


def forecast_of(
    periods: DataFrame,
    roles: Roles,
    keep: str = "oldest",
    boosted: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Next period as display texts; no row with fewer than two points.

    Made from the whole series, unless the caller asks for ``limit`` periods.
    """
    series = series_of(periods, keep, limit)
    picked = pick_of_three(series, horizon=1) if boosted else fc.pick_for(series)
    summary = fc.forecast_summary(picked)
    return summary.where(F.col("n") >= 2).select(
        F.lit(FORECAST_TITLE.format(roles.primary)).alias("label"),
        F.col("forecast_value").alias("value"),
        thousands(F.col("forecast_value"), T.DoubleType()).alias("value_text"),
        trend_text(F.col("forecast_trend")).alias("trend"),
        "trend_class",
        percent_text(F.col("forecast_accuracy")).alias("accuracy"),
    )


# Sections of the frame itself -------------------------------------------------------------


def dyn_trend(
    frame: DataFrame,
    roles: Roles,
    keep: str = "oldest",
    raw_text_period: bool = False,
    limit: int | None = LIMITS.periods,
) -> DataFrame:
    return trend_points(by_period(frame, roles, raw_text_period), keep, limit)


def dyn_top_category(frame: DataFrame, roles: Roles) -> DataFrame:
    return top_points(by_category(frame, roles))


def dyn_distribution(
    frame: DataFrame, roles: Roles, place: int, limits: Limits = LIMITS
) -> DataFrame:
    """Row counts of the second (place 1, ten groups) or third (place 2, eight) category."""
    most = limits.top_groups if place == 1 else limits.pie_groups
    return count_points(by_category(frame, roles, place), most)


def scalar_measures(roles: Roles, limits: Limits = LIMITS) -> list[Column]:
    """Everything the cards and insights need, for one aggregate."""
    measures = [F.count(F.lit(1)).alias("records")]
    for i, name in enumerate(roles.numeric[: limits.cards]):
        measures.append(exact_sum(name, roles.type_of(name)).alias(f"sum_{i}"))
    if roles.primary is not None:
        measures.append(F.avg(named(roles.primary)).alias("mean"))
        measures.append(F.max(named(roles.primary)).alias("peak"))
    return measures


def kpis_of(scalars: DataFrame, roles: Roles, limits: Limits = LIMITS) -> DataFrame:
    """Total cards; a column without any value has none, and no card means a row count."""
    rows = []
    for i, name in enumerate(roles.numeric[: limits.cards]):
        total = F.col(f"sum_{i}")
        rows.append(
            {
                "pos": F.lit(i),
                "id": F.lit(f"kpi_{i}"),
                "title": F.lit(TOTAL_TITLE.format(name)),
                "value": total.cast("double"),
                "value_text": _sum_text(total, roles.type_of(name)),
                "shown": total.isNotNull(),
            }
        )
    none_shown = F.lit(True)
    for row in rows:
        none_shown = none_shown & ~row["shown"]
    rows.append(
        {
            "pos": F.lit(0),
            "id": F.lit("kpi_0"),
            "title": F.lit(RECORDS_TITLE),
            "value": F.col("records").cast("double"),
            "value_text": whole(F.col("records")),
            "shown": none_shown,
        }
    )
    return rows_from(scalars, rows).where("shown").drop("shown")


def _sum_text(total: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.IntegralType):
        return whole(total)
    return thousands(total, dtype)


def dyn_kpis(frame: DataFrame, roles: Roles, limits: Limits = LIMITS) -> DataFrame:
    return kpis_of(frame.agg(*scalar_measures(roles, limits)), roles, limits)


def insights_of(groups: DataFrame | None, scalars: DataFrame, roles: Roles) -> DataFrame:
    """Most frequent value, mean and maximum: (pos, title, value, description)."""
    frames = []
    if groups is not None:
        frames.append(
            mode_of(groups).select(
                F.lit(0).alias("pos"),
                F.lit(MODE_TITLE.format(roles.categorical[0])).alias("title"),
                F.coalesce(F.col("label"), F.lit(NULL_LABEL)).alias("value"),
                F.format_string(MODE_TEXT, whole(F.col("records"))).alias("description"),
            )
        )
    if roles.primary is not None:
        name, dtype = roles.primary, roles.type_of(roles.primary)
        mean_type = dtype if isinstance(dtype, T.DecimalType) else T.DoubleType()
        frames.append(
            rows_from(
                scalars,
                [
                    {
                        "pos": F.lit(1),
                        "title": F.lit(MEAN_TITLE.format(name)),
                        "value": thousands(F.col("mean"), mean_type),
                        "description": F.lit(MEAN_TEXT),
                    },
                    {
                        "pos": F.lit(2),
                        "title": F.lit(PEAK_TITLE.format(name)),
                        "value": thousands(F.col("peak"), dtype),
                        "description": F.lit(PEAK_TEXT),
                    },
                ],
            )
        )
    insights = frames[0]
    for frame in frames[1:]:
        insights = insights.unionByName(frame)
    return insights


def dyn_insights(frame: DataFrame, roles: Roles) -> DataFrame:
    groups = by_category(frame, roles) if roles.categorical else None
    return insights_of(groups, frame.agg(*scalar_measures(roles)), roles)


def dyn_charts(frame: DataFrame, roles: Roles) -> DataFrame:
    points = {}
    for section, _, _ in chart_specs(roles):
        if section == "trend":
            points[section] = dyn_trend(frame, roles)
        elif section == "top":
            points[section] = dyn_top_category(frame, roles)
        else:
            points[section] = dyn_distribution(frame, roles, 1 if section == "second" else 2)
    return charts_of(roles, points)


def top_items(frame: DataFrame, roles: Roles) -> DataFrame:
    return top_items_of(by_category(frame, roles), roles)


def dyn_forecast(
    frame: DataFrame,
    roles: Roles,
    keep: str = "oldest",
    raw_text_period: bool = False,
    limit: int | None = None,
    boosted: bool = False,
) -> DataFrame:
    return forecast_of(by_period(frame, roles, raw_text_period), roles, keep, boosted, limit)


def preview_order(frame: DataFrame, roles: Roles) -> list[Column]:
    """The primary number, largest first, then all other sortable columns, so that the choice
    is the same on every run."""
    others = [
        named(f.name).asc()
        for f in frame.schema.fields
        if f.name != roles.primary and not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    largest = [] if roles.primary is None else [named(roles.primary).desc()]
    return largest + others


def preview(frame: DataFrame, roles: Roles, rows: int = LIMITS.preview_rows) -> DataFrame:
    """The rows with the largest primary number, or the first rows where there is no number."""
    order = preview_order(frame, roles)
    return frame.orderBy(*order).limit(rows) if order else frame.limit(rows)
