"""Key figures, breakdowns, month series and top products of a sales table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions import dates
from tillsight.functions.columns import named

TOP_PRODUCTS = 5


def or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def _sum(name: str) -> Column:
    return or_zero(F.sum(named(name)))


def kpi_summary(sales: DataFrame) -> DataFrame:
    """All key figures in one aggregate. ``total_orders`` counts rows with an order id."""
    return sales.agg(
        _sum("Sales").alias("total_sales"),
        _sum("Profit").alias("total_profit"),
        F.count(named("Order ID")).alias("total_orders"),
        F.round(or_zero(F.avg("Discount")) * 100, 2).alias("avg_discount"),
    )


def _mean_discount() -> Column:
    return F.sum("discount_sum") / F.nullif(F.sum("discount_count"), F.lit(0))


def kpis_of_totals(totals: DataFrame) -> DataFrame:
    """The key figures from rows that already are sums over several order lines.

    Such rows count their lines in ``orders`` and carry the sum and the number of their
    discounts; see :func:`tillsight.sources.star.sales_totals`.
    """
    return totals.agg(
        _sum("Sales").alias("total_sales"),
        _sum("Profit").alias("total_profit"),
        F.coalesce(F.sum("orders"), F.lit(0)).alias("total_orders"),
        F.round(or_zero(_mean_discount()) * 100, 2).alias("avg_discount"),
    )


def total_sales(sales: DataFrame) -> DataFrame:
    return sales.agg(F.round(_sum("Sales"), 2).alias("total_sales"))


def total_profit(sales: DataFrame) -> DataFrame:
    return sales.agg(F.round(_sum("Profit"), 2).alias("total_profit"))


def total_orders(sales: DataFrame) -> DataFrame:
    """Row count: every order line counts, with or without an order id."""
    return sales.agg(F.count(F.lit(1)).alias("total_orders"))


def avg_discount(sales: DataFrame) -> DataFrame:
    return sales.agg(F.round(or_zero(F.avg("Discount")) * 100, 2).alias("avg_discount"))


def sales_by(sales: DataFrame, column: str) -> DataFrame:
    """Sales per value of one column; null is a group of its own."""
    return sales.groupBy(named(column)).agg(_sum("Sales").alias("total_sales"))


def monthly_sales(sales: DataFrame) -> DataFrame:
    """Season profile: calendar months across all years, in calendar order."""
    return (
        sales.groupBy("Month", "month_num")
        .agg(_sum("Sales").alias("monthly_sales"))
        .orderBy("month_num")
    )


def year_month_series(sales: DataFrame) -> DataFrame:
    """Sales per month in order of time; rows without a date are left out."""
    day = named("Order Date")
    return (
        sales.where(day.isNotNull())
        .groupBy(dates.month_start(day).alias("period"))
        .agg(_sum("Sales").alias("monthly_sales"))
        .select(
            F.year("period").alias("year"),
            F.month("period").alias("month_num"),
            dates.month_label(F.col("period")).alias("label"),
            "monthly_sales",
        )
        .orderBy("year", "month_num")
    )


def product_totals(sales: DataFrame) -> DataFrame:
    return sales.groupBy(named("Product Name")).agg(
        _sum("Sales").alias("total_sales"), _sum("Profit").alias("total_profit")
    )


def best_products(totals: DataFrame, limit: int = TOP_PRODUCTS) -> DataFrame:
    """Largest sales first; equal sales in order of name."""
    return totals.orderBy(F.desc("total_sales"), F.asc("Product Name")).limit(limit)


def top_products(sales: DataFrame, limit: int = TOP_PRODUCTS) -> DataFrame:
    return best_products(product_totals(sales), limit)


def years(sales: DataFrame) -> DataFrame:
    """Years present, ascending, as text for a choice list."""
    return (
        sales.select("Year")
        .where(F.col("Year").isNotNull())
        .distinct()
        .orderBy("Year")
        .select(F.col("Year").cast("string").alias("year"))
    )


# Names of the sections of :func:`sales_cells`, in the order of its grouping sets.
REGION, CATEGORY, SEGMENT, MONTH, PRODUCT, PERIOD, TOTAL = (
    "region",
    "category",
    "segment",
    "month",
    "product",
    "period",
    "total",
)
_SECTION_KEYS = {
    REGION: ("Region",),
    CATEGORY: ("Category",),
    SEGMENT: ("Segment",),
    MONTH: ("Month", "month_num"),
    PRODUCT: ("Product Name",),
    PERIOD: ("period",),
    TOTAL: (),
}
_OTHER_KEYS = {k for s, keys in _SECTION_KEYS.items() if s != PRODUCT for k in keys}
ORDER_SIDE = (REGION, SEGMENT, MONTH, PERIOD)
# Columns of order lines, and of rows that already sum several lines.
_MEASURED = ("Order ID", "Sales", "Profit", "Discount", "orders", "discount_sum", "discount_count")


def sales_cells(
    sales: DataFrame, sections: tuple[str, ...] = (REGION, CATEGORY, SEGMENT, MONTH, TOTAL)
) -> DataFrame:
    """Every requested breakdown in one pass over the sales rows.

    One row per section and group. The section is a key of its own, so a group whose own
    key is null stays apart from the keys that the section does not use. The rows fan out
    once per section, but are summed in the same task before the shuffle, which carries at
    most one row per group and task. A plain grouping, unlike grouping sets, is also found
    again by each part of a union once it is persisted.
    """
    keys = [key for section in sections for key in _SECTION_KEYS[section]]
    used = {*_MEASURED, *keys} - {"period"}
    frame = sales.select(
        *[named(c) for c in sales.columns if c in used],
        *([dates.month_start(named("Order Date")).alias("period")] if "period" in keys else []),
    )
    present = set(frame.columns)
    measured = [_sum("Sales").alias("total_sales")]
    if "Profit" in present:
        measured.append(_sum("Profit").alias("total_profit"))
    if "orders" in present:
        measured.append(F.sum("orders").alias("total_orders"))
    elif "Order ID" in present:
        measured.append(F.count(named("Order ID")).alias("total_orders"))
    if "discount_count" in present:
        measured.append(_mean_discount().alias("avg_discount"))
    elif "Discount" in present:
        measured.append(F.avg("Discount").alias("avg_discount"))
    entries = [
        F.struct(
            F.lit(s).alias("section"),
            *[
                (named(k) if k in _SECTION_KEYS[s] else F.lit(None).cast(frame.schema[k].dataType)).alias(k)
                for k in keys
            ],
        )
        for s in sections
    ]
    amounts = [named(c) for c in frame.columns if c in _MEASURED]
    spread = frame.select(*amounts, F.inline(F.array(*entries)))
    return spread.groupBy("section", *[named(k) for k in keys]).agg(*measured)


def shown(cells: DataFrame, products: int = TOP_PRODUCTS) -> DataFrame:
    """The cells without the products that no list shows.

    Every other cell is alone in its partition of the window, and each task hands on the
    best products only, so no section is gathered whole.
    """
    if "Product Name" not in cells.columns:
        return cells
    others = [named(c) for c in cells.columns if c in _OTHER_KEYS]
    order = Window.partitionBy("section", *others).orderBy(
        F.desc("total_sales"), F.asc(named("Product Name"))
    )
    ranked = cells.withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= products).drop("place")


def labelled(cells: DataFrame) -> DataFrame:
    """Cells of one-label sections as (section, label, month_num, total_sales)."""
    number = F.col("month_num") if "month_num" in cells.columns else F.lit(None).cast("int")
    return cells.select(
        "section", label_of(cells).alias("label"), number.alias("month_num"), "total_sales"
    )


def label_of(cells: DataFrame) -> Column:
    """The label of a cell's group in the sections that have one label."""
    label = F.lit(None).cast("string")
    for section in (MONTH, SEGMENT, CATEGORY, REGION):
        key = _SECTION_KEYS[section][0]
        if key in cells.columns:
            label = F.when(F.col("section") == section, named(key)).otherwise(label)
    return label


def breakdowns_one_pass(sales: DataFrame) -> DataFrame:
    """Region, category, segment and month breakdowns and the total."""
    return labelled(sales_cells(sales))


def cells_by_side(
    order_totals: DataFrame, part_totals: DataFrame, sections: tuple[str, ...]
) -> DataFrame:
    """The cells from amounts that were summed per order and per part.

    One pass per side of a star schema: neither side ever joins single order lines, and a
    key with many lines has become few rows before the join.
    """
    by_order = tuple(s for s in sections if s in ORDER_SIDE)
    by_part = tuple(s for s in sections if s not in ORDER_SIDE)
    if not by_part:
        return sales_cells(order_totals, by_order)
    if not by_order:
        return sales_cells(part_totals, by_part)
    return sales_cells(order_totals, by_order).unionByName(
        sales_cells(part_totals, by_part), allowMissingColumns=True
    )


def breakdowns_by_side(order_totals: DataFrame, part_totals: DataFrame) -> DataFrame:
    """The breakdowns of :func:`breakdowns_one_pass`, one pass per side."""
    sections = (REGION, SEGMENT, MONTH, CATEGORY, TOTAL)
    return labelled(cells_by_side(order_totals, part_totals, sections))
