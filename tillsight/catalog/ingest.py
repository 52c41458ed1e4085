"""Scans, typing and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.catalog.registry import Catalog, table
from tillsight.functions import dates
from tillsight.operators import clean
from tillsight.plans.holding import TABLE, held
from tillsight.sources.readers import scan_csv
from tillsight.sources.reuse import DatasetReuse
from tillsight.sources.refresh import FileTotals
from tillsight.sources.sales import AMOUNTS, rejects, type_sales
from tillsight.sources.shared import delete_at_exit, shared_folder

CATALOG = Catalog()

# Order dates as text in the forms a sales file mixes; the form goes with the priority.
_DATE_TEXT_SQL = """CASE o_orderpriority
    WHEN '1-URGENT' THEN strftime(o_orderdate, '%-m/%-d/%Y')
    WHEN '2-HIGH' THEN strftime(o_orderdate, '%m-%d-%Y')
    WHEN '3-MEDIUM' THEN '  ' || strftime(o_orderdate, '%m/%d/%Y') || ' '
    WHEN '5-LOW' THEN strftime(o_orderdate, '%Y-%m-%d')
    ELSE strftime(o_orderdate, '%m/%d/%Y') END"""
_PARSED_SQL = """coalesce(CAST(try_strptime(trim(raw), '%m/%d/%Y') AS DATE),
    CAST(try_strptime(trim(raw), '%m-%d-%Y') AS DATE))"""


def _date_text():
    priority, day = F.col("o_orderpriority"), F.col("o_orderdate").cast("date")
    return (
        F.when(priority == "1-URGENT", F.date_format(day, "M/d/yyyy"))
        .when(priority == "2-HIGH", F.date_format(day, "MM-dd-yyyy"))
        .when(priority == "3-MEDIUM", F.concat(F.lit("  "), F.date_format(day, "MM/dd/yyyy"), F.lit(" ")))
        .when(priority == "5-LOW", F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.date_format(day, "MM/dd/yyyy"))
    )


@CATALOG.query(
    """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
       o_orderpriority
FROM orders
""",
    name="scan_csv",
)
def scan_csv_table(spark, root):
    orders = table(spark, root, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    folder = shared_folder(spark)
    orders.write.option("header", True).csv(folder)
    delete_at_exit(spark, folder)
    return scan_csv(spark, folder, orders.schema)


_RAW_SQL = f"""
  SELECT l_orderkey AS "Order ID", {_DATE_TEXT_SQL} AS raw,
         CASE l_returnflag WHEN 'A' THEN 'n/a' ELSE CAST(l_extendedprice AS VARCHAR) END AS "Sales",
         CASE l_linestatus WHEN 'F' THEN '' ELSE CAST(l_tax AS VARCHAR) END AS "Profit",
         CAST(l_discount AS VARCHAR) AS "Discount"
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
"""


@CATALOG.query(
    f"""
WITH raw AS ({_RAW_SQL}), typed AS (SELECT *, {_PARSED_SQL} AS d FROM raw)
SELECT "Order ID", d AS "Order Date", TRY_CAST("Sales" AS DOUBLE) AS "Sales",
       TRY_CAST("Profit" AS DOUBLE) AS "Profit", TRY_CAST("Discount" AS DOUBLE) AS "Discount",
       strftime(d, '%b') AS "Month", CAST(year(d) AS INTEGER) AS "Year",
       CAST(month(d) AS INTEGER) AS month_num
FROM typed
"""
)
def sales_ingest(spark, root):
    return type_sales(_raw_sales(spark, root))


def _raw_sales(spark, root):
    """Order lines with dates and amounts as text, some of them bad or blank."""
    orders = table(spark, root, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), _date_text().alias("Order Date")
    )
    return (
        table(spark, root, "lineitem")
        .join(orders, "l_orderkey", "left")
        .select(
            F.col("l_orderkey").alias("Order ID"),
            "Order Date",
            F.when(F.col("l_returnflag") == "A", "n/a")
            .otherwise(F.col("l_extendedprice").cast("string"))
            .alias("Sales"),
            F.when(F.col("l_linestatus") == "F", "")
            .otherwise(F.col("l_tax").cast("string"))
            .alias("Profit"),
            F.col("l_discount").cast("string").alias("Discount"),
        )
    )


def _amount_counts_sql(name: str) -> str:
    return f"""
       count(*) FILTER ("{name}" IS NULL OR trim("{name}") = '') AS missing_{name.lower()},
       count(*) FILTER (trim("{name}") <> '' AND TRY_CAST("{name}" AS DOUBLE) IS NULL) AS bad_{name.lower()}"""


@CATALOG.query(
    f"""
WITH raw AS ({_RAW_SQL}), typed AS (SELECT *, {_PARSED_SQL} AS d FROM raw)
SELECT count(*) AS rows, count(*) FILTER (raw IS NULL OR trim(raw) = '') AS missing_dates,
       count(*) FILTER (trim(raw) <> '' AND d IS NULL) AS bad_dates,
       count(*) FILTER (d IS NULL) AS undated_rows,
       {", ".join(map(_amount_counts_sql, AMOUNTS))}
FROM typed
"""
)
def ingest_rejects(spark, root):
    return rejects(_raw_sales(spark, root))


@CATALOG.query(
    f"""
WITH r AS (SELECT o_orderkey, {_DATE_TEXT_SQL} AS raw FROM orders)
SELECT o_orderkey, raw, {_PARSED_SQL} AS parsed FROM r
"""
)
def date_parse(spark, root):
    texts = table(spark, root, "orders").select("o_orderkey", _date_text().alias("raw"))
    return texts.withColumn("parsed", dates.parse_date(F.col("raw")))


@CATALOG.query(
    """
SELECT o_orderkey, strftime(o_orderdate, '%b') AS "Month",
       CAST(year(o_orderdate) AS INTEGER) AS "Year", CAST(month(o_orderdate) AS INTEGER) AS month_num
FROM orders
"""
)
def date_parts(spark, root):
    day = F.col("o_orderdate").cast("date")
    return table(spark, root, "orders").select(
        "o_orderkey",
        dates.month_name(day).alias("Month"),
        F.year(day).alias("Year"),
        F.month(day).alias("month_num"),
    )


@CATALOG.query("SELECT o_orderkey, strftime(o_orderdate, '%b %Y') AS label FROM orders")
def month_label(spark, root):
    day = F.col("o_orderdate").cast("date")
    return table(spark, root, "orders").select("o_orderkey", dates.month_label(day).alias("label"))


@CATALOG.query(
    f"""
WITH r AS (SELECT o_orderkey, o_orderdate, {_DATE_TEXT_SQL} AS raw FROM orders)
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS period,
       strftime(o_orderdate, '%Y-%m') AS text_period, substring(raw, 1, 7) AS raw_text_period
FROM r
"""
)
def period_key(spark, root):
    orders = table(spark, root, "orders")
    text = T.StringType()
    return orders.withColumn("raw", _date_text()).select(
        "o_orderkey",
        dates.period_key(F.col("o_orderdate"), orders.schema["o_orderdate"].dataType).alias("period"),
        dates.period_key(F.col("raw"), text).alias("text_period"),
        dates.period_key(F.col("raw"), text, raw_text_period=True).alias("raw_text_period"),
    )


_AMOUNT_TEXT_SQL = """CASE l_returnflag WHEN 'A' THEN 'n/a' WHEN 'R' THEN ''
    ELSE CAST(l_extendedprice AS VARCHAR) END"""


@CATALOG.query(
    f"""
SELECT l_orderkey, {_AMOUNT_TEXT_SQL} AS raw, TRY_CAST({_AMOUNT_TEXT_SQL} AS DOUBLE) AS amount
FROM lineitem
"""
)
def cast_double(spark, root):
    raw = (
        F.when(F.col("l_returnflag") == "A", "n/a")
        .when(F.col("l_returnflag") == "R", "")
        .otherwise(F.col("l_extendedprice").cast("string"))
    )
    lines = table(spark, root, "lineitem").select("l_orderkey", raw.alias("raw"))
    return lines.withColumn("amount", F.col("raw").try_cast("double"))


@CATALOG.query("SELECT c_mktsegment, count(*) AS customers FROM customer GROUP BY ALL")
def dataset_reuse(spark, root):
    kept = DatasetReuse(spark, lambda session, path: session.read.parquet(path))
    path, columns = f"{root}/customer.parquet", ("c_custkey", "c_mktsegment")
    kept.preload(path, columns)
    counted = kept.load(path, columns=columns).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("customers")
    )
    # The few counts are written from memory, and nothing stays in it.
    found = held(counted, TABLE)
    kept.clear()
    return found


@CATALOG.query(
    """
SELECT 'customer' AS dataset, count(*) AS rows, false AS kept_after_one, false AS kept_after_all
FROM customer
UNION ALL SELECT 'orders', count(*), true, false FROM orders
"""
)
def dataset_release(spark, root):
    """Two datasets are kept, one is released by its path, then all that is left."""
    kept = DatasetReuse(spark, lambda session, path: session.read.parquet(path))
    names = ("customer", "orders")
    paths = {name: f"{root}/{name}.parquet" for name in names}
    for name in names:
        kept.preload(paths[name])
    frames = {name: kept.load(paths[name]) for name in names}
    kept.clear(paths["customer"])
    after_one = {name: frames[name].is_cached for name in names}
    kept.clear()
    counts = [
        frames[name].agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("dataset"),
            "rows",
            F.lit(after_one[name]).alias("kept_after_one"),
            F.lit(frames[name].is_cached).alias("kept_after_all"),
        )
        for name in names
    ]
    return counts[0].unionByName(counts[1])


@CATALOG.query(
    """
SELECT o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice, count(*) AS rows
FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderpriority = '1-URGENT')
GROUP BY ALL
"""
)
def refresh_by_file(spark, root):
    """Totals of a folder of orders, refreshed after urgent orders were added to it once more."""
    orders, landing = table(spark, root, "orders"), shared_folder(spark)
    delete_at_exit(spark, landing)
    totals = FileTotals(
        spark,
        lambda session, files: session.read.parquet(*files),
        ["o_orderstatus"],
        ["o_totalprice"],
        f"{landing}/totals",
    )
    orders.write.parquet(f"{landing}/orders")
    totals.refresh(f"{landing}/orders")
    orders.where("o_orderpriority = '1-URGENT'").write.mode("append").parquet(f"{landing}/orders")
    totals.refresh(f"{landing}/orders")
    return totals.totals().withColumn("o_totalprice", F.round("o_totalprice", 2))


# Cleaning: events whose value or type is missing in a part of the rows, and repeats.

_GAPPY_SQL = """
  SELECT event_id, ts, user_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS event_type,
         CASE WHEN value >= 100 THEN NULL ELSE floor(value) END AS value, props
  FROM events
  UNION ALL
  SELECT event_id, ts, user_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END,
         CASE WHEN value >= 100 THEN NULL ELSE floor(value) END, props
  FROM events WHERE user_id % 3 = 0
"""


def _gappy(spark, root):
    events = table(spark, root, "events")
    gaps = events.withColumns(
        {
            "event_type": F.when(F.col("event_type") != "error", F.col("event_type")),
            "value": F.when(F.col("value") < 100, F.floor("value").cast("double")),
        }
    )
    return gaps.unionByName(gaps.where(F.col("user_id") % 3 == 0))


@CATALOG.query(
    f"""
WITH g AS ({_GAPPY_SQL}) SELECT * FROM g
WHERE COLUMNS(*) IS NOT NULL
"""
)
def clean_dropna(spark, root):
    return clean.drop_incomplete(_gappy(spark, root))


@CATALOG.query(f"WITH g AS ({_GAPPY_SQL}) SELECT DISTINCT * FROM g")
def clean_dedup(spark, root):
    return clean.drop_repeats(_gappy(spark, root))


@CATALOG.query(
    f"""
WITH g AS ({_GAPPY_SQL}) SELECT DISTINCT * FROM g
WHERE COLUMNS(*) IS NOT NULL
"""
)
def clean_data(spark, root):
    return clean.clean(_gappy(spark, root))
