"""Document fingerprints: the smallest hashes of a text's shingles, a bottom-k sketch.

Sketches are sorted arrays of distinct 32-bit numbers. Those of the parts of a text or a
corpus merge into that of the whole; two of them estimate resemblance and containment, one
the number of distinct shingles. All of it is built from column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import GAP, stored

KEPT = 128
WORDS = 5
#: Stands for a null id while texts are joined, so that it is the smallest long.
NO_ID = -(2**63)


def shingle_numbers(text: Column, words: int = WORDS) -> Column:
    """Hashes of the runs of ``words`` words; of a shorter text, one hash of all its words."""
    parts = F.array_remove(F.split(text, GAP), "")

    def number(*columns: Column) -> Column:
        return F.shiftright(F.xxhash64(*columns), 32).cast("int")

    def runs(listed: Column) -> Column:
        # Missing words of a short text are nulls, which the hash passes over.
        starts = F.sequence(F.lit(0), F.greatest(F.size(listed) - words, F.lit(0)))
        found = F.transform(starts, lambda i: number(*[F.get(listed, i + k) for k in range(words)]))
        return F.when(F.size(listed) == 0, F.array().cast("array<int>")).otherwise(found)

    # As the variable of a lambda, the words are split once and not for every shingle.
    return F.flatten(F.transform(F.array(parts), runs))


def smallest(numbers: Column, kept: int = KEPT) -> Column:
    return F.slice(F.sort_array(F.array_distinct(numbers)), 1, kept)


def sketch(text: Column, kept: int = KEPT, words: int = WORDS) -> Column:
    return smallest(shingle_numbers(text, words), kept)


def merge(a: Column, b: Column, kept: int = KEPT) -> Column:
    """The sketch of two parts together. Shingles across the cut are in neither part."""
    return smallest(F.concat(a, b), kept)


def merge_all(sketches: DataFrame, key: str, kept: int = KEPT) -> DataFrame:
    """One sketch for each ``key`` from ``key, sketch``: sums are taken before the shuffle.

    A window keeps the smallest numbers of each key in every task first, so a key that holds
    a third of all rows moves ``kept`` numbers a task.
    """
    numbers = sketches.select(key, F.explode("sketch").alias("number")).distinct()
    order = Window.partitionBy(key).orderBy("number")
    few = numbers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)
    return few.groupBy(key).agg(F.sort_array(F.collect_list("number")).alias("sketch"))


def _common(a: Column, b: Column, union: Column) -> Column:
    return F.size(F.array_intersect(F.array_intersect(a, b), union))


def resemblance(a: Column, b: Column, kept: int = KEPT) -> Column:
    """Estimated similarity of two sets, 0 to 1; two empty sets are alike."""
    union = merge(a, b, kept)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(_common(a, b, union) / F.size(union))


def distinct_count(a: Column, kept: int = KEPT) -> Column:
    """Estimated number of distinct shingles; exact for fewer than ``kept``."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**31 + 1)) / F.lit(2.0**32)
    return F.when(F.size(a) < kept, F.size(a).cast("double")).otherwise((kept - 1) / share)


def containment(a: Column, b: Column, kept: int = KEPT) -> Column:
    """Estimated share of the first set that lies in the second; 1 for an empty first set."""
    shared = resemblance(a, b, kept) * distinct_count(merge(a, b, kept), kept)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), shared / distinct_count(a, kept))
    )


def printed(a: Column) -> Column:
    """A sketch as text: eight hex digits for each number, in order."""
    shifted = F.transform(a, lambda x: F.lpad(F.hex(x.cast("long") + 2**31), 8, "0"))
    return F.lower(F.array_join(shifted, ""))


def next_ids(docs: DataFrame) -> DataFrame:
    """``doc_id, next_id`` of all distinct ids, ascending; the first follows the last.

    Ids are dealt to sorted ranges; inside a range the next row is next, and the last row of a
    range is followed by the head of the next one. One row for each range meets in one task.
    """
    ranges = stored(
        docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
        .repartitionByRange("doc_id").select("doc_id", F.spark_partition_id().alias("range")),
        "ranges",
    )
    inside = Window.partitionBy("range").orderBy("doc_id")
    heads = ranges.groupBy("range").agg(F.min("doc_id").alias("head"))
    by_head = Window.orderBy("head")
    whole = by_head.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(
        "range", F.coalesce(F.lead("head").over(by_head), F.min("head").over(whole)).alias("head")
    )
    return (
        ranges.withColumn("next_id", F.lead("doc_id").over(inside))
        .join(heads, "range", "left")
        .select("doc_id", F.coalesce("next_id", "head").alias("next_id"))
    )


def fingerprint(docs: DataFrame, kept: int = KEPT, words: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is the start of
    the next document's.

    Columns ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``, ``n_shingles`` (estimate), ``contained_in_edited``.
    Null texts are empty. A null id is before all others: it is nobody's next document, and
    the smallest id follows it. Of rows with one id, the least text is the next document. An
    empty table gives no rows; further columns are ignored.
    """
    # The key is never null, so that both joins below read one shuffle of the texts.
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), text.alias("text"))
    known = next_ids(docs)
    first = docs.agg(F.min("doc_id").alias("next_id")).where("next_id IS NOT NULL")
    following = known.unionByName(first.select(F.lit(NO_ID).alias("doc_id"), "next_id"))
    need = rows.groupBy("key").agg(F.max(F.length("text") / 4).cast("int").alias("need"))
    asked = need.join(following, need["key"] == following["doc_id"]).select(
        F.col("key").alias("asker"), F.col("next_id").alias("key"), "need"
    )
    given = rows.join(asked, "key").select(
        "asker",
        F.struct(
            F.substring("text", F.lit(1), F.col("need")).alias("start"),
            sketch(F.col("text"), kept, words).alias("sketch"),
        ).alias("gift"),
    )
    given = given.groupBy("asker").agg(F.min("gift").alias("gift"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.length("text") - quarter),
        F.substring(F.coalesce("gift.start", F.lit("")), F.lit(1), quarter),
    )
    sketched = (
        rows.join(given, F.col("key") == F.col("asker"), "left")
        .withColumn("edited", edited)
        .select(
            F.nullif("key", F.lit(NO_ID)).alias("doc_id"),
            F.length("text").cast("long").alias("n_chars"),
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            sketch(F.col("text"), kept, words).alias("own"),
            sketch(F.col("edited"), kept, words).alias("other"),
            F.coalesce("gift.sketch", F.array().cast("array<int>")).alias("next"),
        )
    )
    return sketched.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(F.col("own")).alias("fingerprint"),
        printed(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("other"), kept).alias("near_edited"),
        resemblance(F.col("own"), F.col("next"), kept).alias("near_next"),
        distinct_count(F.col("own"), kept).alias("n_shingles"),
        containment(F.col("own"), F.col("other"), kept).alias("contained_in_edited"),
    )
