"""How a plan keeps the few rows that several of its sections read."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.functions.columns import named
from tillsight.sources.shared import delete_at_exit, shared_folder

#: In executor memory until released; as a table in the shared folder, which needs no
#: release and goes when the application ends; for as long as one plan runs, in the files of
#: a shuffle that all its parts read; or not at all, for a single reader.
MEMORY, TABLE, PLAN, NOT = "memory", "table", "plan", "not"

#: Rows that stand for all rows of a plan's shared frame.
FOLDED = 64


def held(frame: DataFrame, how: str) -> DataFrame:
    if how == MEMORY:
        return frame.persist(StorageLevel.MEMORY_AND_DISK)
    if how == TABLE:
        spark, folder = frame.sparkSession, shared_folder(frame.sparkSession)
        frame.write.parquet(folder)
        delete_at_exit(spark, folder)
        return spark.read.schema(frame.schema).parquet(folder)
    if how == PLAN:
        return folded(frame)
    return frame


def folded(frame: DataFrame, rows: int = FOLDED) -> DataFrame:
    """The same rows, out of arrays that one shuffle makes.

    Readers see through the arrays neither with their columns nor with their filters, so all
    of them ask for the same shuffle, and Spark runs it once for a plan with many readers. No
    job runs before that plan does. The rows are spread over ``rows`` arrays by hash.
    """
    part = F.pmod(F.xxhash64(*[named(c) for c in frame.columns]), F.lit(rows))
    arrays = frame.select(part.alias("part"), F.struct("*").alias("row")).groupBy("part")
    return arrays.agg(F.collect_list("row").alias("rows")).select(F.inline("rows"))
