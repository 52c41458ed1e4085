"""What several operators share: stored intermediate tables, word counts, label samples."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.sources.shared import delete_at_exit, shared_folder

#: White space of the word contracts: space, tab, newline, vertical tab, form feed, return.
GAP = r"[\x20\x09-\x0D]+"


_WORKING: list[str] = []


def working(operator: str, forget: Callable[[], object] | None = None) -> None:
    """Tell that a task of ``operator`` runs in this Python worker.

    Spark uses its workers again, also for other stages. What an operator remembers between
    tasks, and drops by ``forget``, goes when a task of another one begins.
    """
    if _WORKING != [operator]:
        while _FORGET:
            _FORGET.pop()()
        gc.collect()
        returned()
        _WORKING[:] = [operator]
        if forget is not None:
            _FORGET.append(forget)


_FORGET: list[Callable[[], object]] = []


def returned() -> None:
    """Give memory that the worker has freed back to the system, where its C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet under ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage in a way that survives lost executors. The folder goes when the
    application ends.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    frame.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(frame.schema).parquet(path)


def small(frame: DataFrame, name: str, most: int = 100_000) -> DataFrame:
    """The stored frame, to be sent to all tasks if it has no more than ``most`` rows."""
    kept = stored(frame, name)
    return F.broadcast(kept) if kept.count() <= most else kept


def word_count(text: Column) -> Column:
    """Number of runs of anything but white space; 0 for null and empty texts."""
    parts = F.split(F.coalesce(text, F.lit("")), GAP)
    return F.size(F.array_remove(parts, "")).cast("long")


def remainder(doc_id: Column, divisor: int) -> Column:
    """``crc32`` of the id written as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def label_sample(
    labels: DataFrame, column: str, divisor: int, held_out: int, most: int
) -> DataFrame:
    """At most ``most`` labelled ids of each class, outside the held-out fold.

    Columns ``doc_id``, ``y`` (0 or 1) and ``weight``, which restores the share of the class
    among all usable labels. The pick is by hash of the id: the same on every run, and spread
    over the table. Labels that disagree about a document are averaged and rounded up. The
    result has at most ``2 * most`` rows, so it may be broadcast.
    """
    usable = (
        labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
        .where(remainder(F.col("doc_id"), divisor) != held_out)
        .groupBy("doc_id")
        .agg((F.avg(column) >= 0.5).cast("int").alias("y"))
    )
    picked = None
    for y in (0, 1):
        rows = usable.where(F.col("y") == y)
        total = rows.agg(F.count(F.lit(1))).scalar()
        few = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        part = few.select("doc_id", "y", (total / F.least(total, F.lit(most))).alias("weight"))
        picked = part if picked is None else picked.unionByName(part)
    return picked


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``doc_id, y, weight, text`` of the sampled ids that are in ``docs``, a row for each id.

    Of rows that share an id, the smallest text; a null one only if there is no other.
    """
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id")
        .agg(F.first("y").alias("y"), F.first("weight").alias("weight"), F.min("text").alias("text"))
    )
