"""The filtered sales dashboard: every section from one pass over the sales rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.functions.columns import named
from tillsight.functions.numbers import (
    compact_currency,
    percent_text,
    profit_class,
    short_decimal,
    trend_text,
    whole,
)
from tillsight.operators import breakdowns as bd
from tillsight.operators import forecast as fc
from tillsight.operators.boosted import pick_of_three
from tillsight.operators.filters import filter_sales
from tillsight.plans.holding import MEMORY, held

SECTIONS = (bd.REGION, bd.CATEGORY, bd.SEGMENT, bd.MONTH, bd.PRODUCT, bd.PERIOD, bd.TOTAL)


class Dashboard:
    """Sections of one dashboard request, each a DataFrame.

    All but ``years`` derive from ``cells``, one grouping of the filtered rows cut to what
    the sections show. The cells, and the model picked from them, are held on first use:
    in memory, released by :meth:`close`, or as a table (see :mod:`tillsight.plans.holding`).
    The sales frame itself is never touched, so a dataset kept for reuse stays kept.
    """

    def __init__(
        self,
        sales: DataFrame | None,
        year: int | str | None = None,
        region: str | None = None,
        category: str | None = None,
        search: str | None = None,
        boosted: bool = False,
        sections: tuple[str, ...] = SECTIONS,
        cells: DataFrame | None = None,
        hold: str = MEMORY,
        products: int = bd.TOP_PRODUCTS,
    ):
        """``boosted`` adds boosted trees to the forecast's candidates. ``sections`` narrows the
        cells to what will be asked for; then only the columns of those sections need to be
        present. ``products`` is the length of the product list. ``cells`` gives unfiltered
        cells that were made elsewhere, e.g. per side of a star schema, in place of a sales
        frame."""
        if (sales is None) == (cells is None):
            raise ValueError("a dashboard is made either from sales or from cells")
        self._given = cells
        self._sales = sales
        self._rows = filter_sales(sales, year, region, category, search)
        if cells is not None and self._rows is not None:
            raise ValueError("filters need the sales rows")
        self._boosted = boosted
        self._sections = sections
        self._hold = hold
        self._products = products

    def __enter__(self) -> "Dashboard":
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    @cached_property
    def cells(self) -> DataFrame:
        made = self._given
        if made is None:
            made = bd.sales_cells(self._rows, self._sections)
        return held(bd.shown(made, self._products), self._hold)

    def close(self) -> None:
        for name in ("cells", "picked"):
            if name in self.__dict__:
                self.__dict__.pop(name).unpersist()

    def _section(self, name: str) -> DataFrame:
        if name not in self._sections:
            raise ValueError(f"this dashboard was made without the section {name!r}")
        return self.cells.where(F.col("section") == name)

    def sections(self, *names: str) -> DataFrame:
        """The cells of several sections, for one select over all of them."""
        missing = set(names) - set(self._sections)
        if missing:
            raise ValueError(f"this dashboard was made without the sections {sorted(missing)}")
        return self.cells.where(F.col("section").isin(*names))

    def years(self) -> DataFrame:
        """Years to choose from: those of all sales, whatever the filter."""
        if self._rows is self._sales and bd.PERIOD in self._sections:
            return bd.years(self.series().select(F.year("period").alias("Year")))
        return bd.years(self._sales)

    def kpis(self) -> DataFrame:
        """One row, zeros where no row passed the filter."""
        return self._section(bd.TOTAL).agg(
            bd.or_zero(F.max("total_sales")).alias("total_sales"),
            bd.or_zero(F.max("total_profit")).alias("total_profit"),
            F.coalesce(F.max("total_orders"), F.lit(0)).alias("total_orders"),
            F.round(bd.or_zero(F.max("avg_discount")) * 100, 2).alias("avg_discount"),
        )

    def regions(self) -> DataFrame:
        return self._section(bd.REGION).select("Region", "total_sales")

    def categories(self) -> DataFrame:
        return self._section(bd.CATEGORY).select("Category", "total_sales")

    def segments(self) -> DataFrame:
        return self._section(bd.SEGMENT).select("Segment", "total_sales")

    def months(self) -> DataFrame:
        return (
            self._section(bd.MONTH)
            .select("Month", "month_num", F.col("total_sales").alias("monthly_sales"))
            .orderBy("month_num")
        )

    def top_products(self) -> DataFrame:
        return bd.best_products(
            self._section(bd.PRODUCT).select("Product Name", "total_sales", "total_profit"),
            self._products,
        )

    def series(self) -> DataFrame:
        """Month series for the forecast; rows without a date are left out."""
        return (
            self._section(bd.PERIOD)
            .where(F.col("period").isNotNull())
            .select("period", F.col("total_sales").alias("y"), F.month("period").alias("month_num"))
        )

    def history(self) -> DataFrame:
        return fc.history(self.series()).orderBy("period")

    @cached_property
    def picked(self) -> DataFrame:
        """The chosen model, one row; held because several sections predict from it."""
        pick = pick_of_three if self._boosted else fc.pick_for
        return held(pick(self.series()), self._hold)

    def forecast(self) -> DataFrame:
        return fc.forecast_summary(self.picked)

    def forecast_points(self) -> DataFrame:
        return fc.forecast_points(self.picked)

    def documents(self) -> DataFrame:
        """The dashboard as JSON lines: (section, json).

        One line per entry rather than one document, so that no section has to fit into
        a single row; write with ``.write.partitionBy("section").text(path)``.
        """
        sections = {
            "kpis": self.kpis().select(
                compact_currency(F.col("total_sales")).alias("total_sales"),
                compact_currency(F.col("total_profit")).alias("total_profit"),
                whole(F.col("total_orders")).alias("total_orders"),
                _percent(F.col("avg_discount")).alias("avg_discount"),
            ),
            "years": self.years(),
            "regions": _entry(self.regions(), "Region"),
            "categories": _entry(self.categories(), "Category"),
            "segments": _entry(self.segments(), "Segment"),
            "months": self.months().select(
                F.col("month_num").alias("position"),
                F.col("Month").alias("label"),
                _amount(F.col("monthly_sales")).alias("value"),
            ),
            "top_products": self.top_products().select(
                named("Product Name").alias("product_name"),
                compact_currency(F.col("total_sales")).alias("total_sales"),
                compact_currency(F.col("total_profit")).alias("total_profit"),
                profit_class(F.col("total_profit")).alias("profit_class"),
            ),
            "forecast": self.forecast().select(
                compact_currency(F.col("forecast_value")).alias("forecast_value"),
                trend_text(F.col("forecast_trend")).alias("forecast_trend"),
                "trend_class",
                percent_text(F.col("forecast_accuracy")).alias("forecast_accuracy"),
            ),
            "forecast_points": self.forecast_points().select(
                F.col("step").alias("position"), "label", _amount(F.col("forecast")).alias("value")
            ),
            "history": self.history().select("period", "label", _amount(F.col("value")).alias("value")),
        }
        return json_lines(sections)


def json_lines(sections: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of all sections as (section, json)."""
    parts = [
        frame.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("json"))
        for name, frame in sections.items()
    ]
    return reduce(lambda lines, part: lines.unionByName(part), parts)


def _amount(value: Column) -> Column:
    return value.cast("decimal(38,2)")


def _percent(value: Column) -> Column:
    return F.concat(short_decimal(value), F.lit("%"))


def _entry(groups: DataFrame, label: str) -> DataFrame:
    return groups.select(
        named(label).alias("label"), _amount(F.col("total_sales")).alias("value")
    )
