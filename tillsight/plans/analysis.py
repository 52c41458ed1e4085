"""Full analysis of any table: two passes over the rows feed every section."""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions import dates
from tillsight.functions.columns import named
from tillsight.operators import adaptive as ad
from tillsight.operators import profile
from tillsight.operators.filters import filter_columns
from tillsight.operators.roles import Roles, classify, listed_roles
from tillsight.plans.dashboard import json_lines
from tillsight.plans.holding import MEMORY, held
from tillsight.sources.reuse import DatasetReuse

# Names of the sections of the cells. The most frequent value of the first category has a
# section of its own, because it is ranked otherwise than the chart of that category.
PERIOD, FIRST, SECOND, THIRD = "period", "first", "second", "third"
MODE, ALL = "mode", "all"


_RANK = " rank"


def _one(frame: DataFrame) -> DataFrame:
    """The row of a frame as JSON; null where there is none."""
    return frame.agg(F.to_json(F.first(F.struct("*"))).alias("json"))


def _listed(frame: DataFrame, order: list[str], *entry: str | Column) -> DataFrame:
    """All rows of a small frame as a JSON list, in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.struct(*entry).alias("entry"))))
    return frame.agg(F.to_json(F.transform(rows, lambda row: row["entry"])).alias("json"))


def json_sections(sections: Mapping[str, DataFrame]) -> DataFrame:
    """One row for each section: (section, json)."""
    parts = [frame.select(F.lit(name).alias("section"), "json") for name, frame in sections.items()]
    return reduce(DataFrame.unionByName, parts)


class Analysis:
    """Sections of one analysis, each a DataFrame.

    ``cells`` holds, from one pass over the filtered rows, the periods, the leading
    categories and the totals of the whole table, each section cut to what it shows. It is
    held on first use: in memory, released by :meth:`close`, or otherwise as ``hold`` says
    (see :mod:`tillsight.plans.holding`). The preview is the second pass. Filter choices are
    taken from the unfiltered table.
    """

    def __init__(
        self,
        frame: DataFrame,
        filters: Mapping[str, str] | None = None,
        primary: str | None = None,
        keep: str = "oldest",
        raw_text_period: bool = False,
        boosted: bool = False,
        limits: ad.Limits = ad.LIMITS,
        hold: str = MEMORY,
    ):
        """``keep`` is which periods the trend chart shows when there are more than its
        limit; the forecast uses all of them."""
        self.base = frame
        self.rows = filter_columns(frame, filters)
        self.roles: Roles = classify(frame, primary)
        self._keep = keep
        self._raw = raw_text_period
        self._boosted = boosted
        self._limits = limits
        self._hold = hold

    def __enter__(self) -> "Analysis":
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    @cached_property
    def cells(self) -> DataFrame:
        return held(self._cut(self._grouped()), self._hold)

    def _grouped(self) -> DataFrame:
        """One row per section and group. Numbers other than the primary one go with the
        whole table only, under names of their own."""
        roles = self.roles
        labels = dict(zip((FIRST, SECOND, THIRD), map(named, roles.categorical)))
        period, kind = F.lit(None).cast("string"), "string"
        dated = bool(roles.date) and roles.primary is not None
        if dated:
            day = roles.date[0]
            period = dates.period_group(named(day), roles.type_of(day), self._raw)
            kind = self.rows.select(period.alias("p")).schema["p"].dataType
        cards = list(roles.numeric[: self._limits.cards])

        def entry(section: str) -> Column:
            whole, none = section == ALL, F.lit(None)
            parts = [
                F.lit(section).alias("section"),
                (labels[section] if section in labels else none.cast("string")).alias("label"),
                (period if section == PERIOD else none.cast(kind)).alias("period"),
            ]
            for i, name in enumerate(cards):
                value = named(name) if whole else none.cast(roles.type_of(name))
                parts.append(value.alias(f"card_{i}"))
            if roles.primary is not None:
                dtype = roles.type_of(roles.primary)
                parts.append(named(roles.primary).alias("amount"))
                parts.append((named(roles.primary) if whole else none.cast(dtype)).alias("each"))
            return F.struct(*parts)

        sections = [*([PERIOD] if dated else []), *labels, ALL]
        measures = [F.count(F.lit(1)).alias("records")]
        for i, name in enumerate(cards):
            measures.append(ad.exact_sum(f"card_{i}", roles.type_of(name)).alias(f"sum_{i}"))
        if roles.primary is not None:
            total = ad.exact_sum("amount", roles.type_of(roles.primary))
            measures += [total.alias("total"), F.avg("each").alias("mean"), F.max("each").alias("peak")]
        spread = self.rows.select(F.inline(F.array(*map(entry, sections))))
        return spread.groupBy("section", "label", "period").agg(*measures)

    def _cut(self, groups: DataFrame) -> DataFrame:
        """Leave what the sections show: of each category its largest groups.

        Each period is alone in its partition of the window and stays. Tasks hand on the
        largest groups only, so no section is gathered whole.
        """
        limits = self._limits
        twice = F.when(F.col("section") == FIRST, F.array(F.lit(FIRST), F.lit(MODE))).otherwise(
            F.array("section")
        )
        if self.roles.primary is None:
            ranked_by = [F.desc("records")]
        else:
            first = F.col("section") == FIRST
            ranked_by = [F.when(first, F.col("total")).desc(), F.when(~first, F.col("records")).desc()]
        order = Window.partitionBy("section", "period").orderBy(*ranked_by, F.asc("label"))
        most = max(limits.top_groups, limits.pie_groups, 1)
        return (
            groups.withColumn("section", F.explode(twice))
            .withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= most)
            .drop("place")
        )

    def close(self) -> None:
        if "cells" in self.__dict__:
            self.__dict__.pop("cells").unpersist()

    def _labelled(self) -> DataFrame:
        """The cells, a period as its text."""
        if not self.roles.date:
            return self.cells
        text = dates.period_text(F.col("period"), self.roles.type_of(self.roles.date[0]))
        label = F.when(F.col("section") == PERIOD, text).otherwise(F.col("label"))
        return self.cells.withColumn("label", label)

    def _groups(self, section: str) -> DataFrame:
        measures = ["records"] + (["total"] if self.roles.primary is not None else [])
        return self._labelled().where(F.col("section") == section).select("label", *measures)

    def _scalars(self) -> DataFrame:
        """One row also for an empty table, which has no cells."""
        found = self.cells.where(F.col("section") == ALL)
        names = [c for c in found.columns if c not in ("section", "label", "period")]
        return found.agg(
            *[
                (F.coalesce(F.max(c), F.lit(0)) if c == "records" else F.max(c)).alias(c)
                for c in names
            ]
        )

    def column_roles(self) -> DataFrame:
        return listed_roles(self.base)

    def filter_candidates(self) -> DataFrame:
        return ad.filter_candidates(self.base, self.roles, self._limits)

    def filter_values(self) -> DataFrame:
        return ad.filter_values(self.base, self.roles, self._limits)

    def shape(self) -> DataFrame:
        """Rows and columns; the rows were counted with the cells."""
        return profile.shape_of(self._scalars().select(F.col("records").alias("rows")), len(self.rows.columns))

    def preview(self) -> DataFrame:
        return ad.preview(self.rows, self.roles, self._limits.preview_rows)

    def kpis(self) -> DataFrame:
        return ad.kpis_of(self._scalars(), self.roles, self._limits)

    def charts(self) -> DataFrame | None:
        """All charts in long form; None where the roles allow none."""
        if not ad.chart_specs(self.roles):
            return None
        return ad.charts_from(self._labelled(), self.roles, self._keep, self._limits)

    def top_items(self) -> DataFrame | None:
        if not self.roles.categorical or self.roles.primary is None:
            return None
        return ad.top_items_of(self._groups(FIRST), self.roles, self._limits.top_groups)

    def forecast(self) -> DataFrame | None:
        if not self.roles.date or self.roles.primary is None:
            return None
        return ad.forecast_of(self._groups(PERIOD), self.roles, boosted=self._boosted)

    def insights(self) -> DataFrame | None:
        groups = self._groups(MODE) if self.roles.categorical else None
        if groups is None and self.roles.primary is None:
            return None
        return ad.insights_of(groups, self._scalars(), self.roles)

    def document(self) -> DataFrame:
        """The whole analysis as one nested JSON document: one row, ``json``.

        Every list in it is bounded by ``limits``, except for the choice of unlimited periods.
        Charts hold ``labels`` and ``values``; absent sections are null or empty lists.
        """
        roles = self.roles
        value = F.col("value").cast("decimal(38,2)").alias("value")
        charts, top, forecast, insights = self.charts(), self.top_items(), self.forecast(), self.insights()
        names = F.array(*[F.lit(c) for c in self.base.columns])
        kinds = [(kind, getattr(roles, kind)) for kind in ("numeric", "categorical", "date")]
        listed = F.struct(
            names.alias("all"),
            *[F.array(*map(F.lit, found)).cast("array<string>").alias(kind) for kind, found in kinds],
        )
        sections: dict[str, DataFrame | None] = {
            "shape": _one(self.shape().select("rows", "columns", "shape")),
            "columns": _one(self._scalars().select(listed.alias("c")).select("c.*")),
            "filters": _listed(
                self.filter_values()
                .groupBy("ordinal", "column")
                .agg(F.array_sort(F.collect_list("value")).alias("values")),
                ["ordinal"],
                "column",
                "values",
            ),
            "kpis": _listed(self.kpis(), ["pos"], "id", "title", "value_text", value),
            "charts": charts
            and _listed(
                charts.groupBy("chart_id", "title", "type")
                .agg(F.array_sort(F.collect_list(F.struct("pos", "label", value))).alias("points"))
                .withColumns({"labels": F.col("points.label"), "values": F.col("points.value")}),
                ["chart_id"],
                *(F.col("chart_id").alias("id"), "title", "type", "labels", "values"),
            ),
            "top_items": top and _listed(top, ["rank"], "rank", "label", "value_text", value, "share_pct"),
            "forecast": forecast and _one(forecast.drop("value")),
            "insights": insights and _listed(insights, ["pos"], "title", "value", "description"),
            "preview": _listed(*self._ranked_preview(), *map(named, self.base.columns)),
        }
        lines = json_sections({k: v for k, v in sections.items() if v is not None})
        order = list(sections)
        found = F.map_from_entries(F.collect_list(F.struct("section", "json")))
        text = F.concat(
            F.lit("{"),
            F.concat_ws(
                ",",
                *[
                    F.concat(F.lit(f'"{name}":'), F.coalesce(F.col("found")[name], F.lit("null")))
                    for name in order
                ],
            ),
            F.lit("}"),
        )
        return lines.agg(found.alias("found")).select(text.alias("json"))

    def _ranked_preview(self) -> tuple[DataFrame, list[str]]:
        preview = self.preview()
        order = ad.preview_order(preview, self.roles) or [F.lit(0)]
        rank = F.row_number().over(Window.orderBy(*order))
        return preview.withColumn(_RANK, rank), [_RANK]

    def documents(self) -> DataFrame:
        """The sections as JSON lines: (section, json); absent sections have no lines."""
        sections = {
            "shape": self.shape().select("shape"),
            "kpis": self.kpis(),
            "charts": self.charts(),
            "top_items": self.top_items(),
            "forecast": self.forecast(),
            "insights": self.insights(),
            "filters": self.filter_values(),
            "preview": self.preview(),
        }
        return json_lines({k: v for k, v in sections.items() if v is not None})


def analyze_path(
    reuse: DatasetReuse, path: str, filters: Mapping[str, str] | None = None, **options
) -> Analysis:
    """Analysis of a file or folder that is kept in memory between requests.

    A path with nothing in it fails with Spark's own error.
    """
    return Analysis(reuse.load(path), filters, **options)


def analyze(frame: DataFrame, filters: Mapping[str, str] | None = None, **options) -> Analysis:
    """Analysis of a table; ``filters`` maps columns to the chosen text values."""
    return Analysis(frame, filters, **options)
