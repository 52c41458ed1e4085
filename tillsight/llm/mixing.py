"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 52-bit number from a hash. A source takes all its documents as often as
its target fills them whole, and for the rest those whose number lies at or below one
threshold. The threshold comes from histograms of tokens per hash bucket: the boundary bucket
of the first histogram is split by the next bits, and so on, until a bucket is one hash value.
Nothing is sorted, and only the boundary bucket of each source is looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import stored, word_count

#: Bits of the hash by which each histogram refines the one before; they sum to 52.
LEVELS = (13, 13, 13, 13)


def hash_number(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """52 bits of a hash of id and text, as a long. Rows alike in both get the same number."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), text)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """The target of every source; ``sizes`` has ``source`` and ``source_size``, a row each.

    Sources by code point, null last, get ``weights`` in turn and share ``share`` times all
    sizes. No target exceeds ``most`` times its source's size; what lies above goes to the
    others by weight. The final level is found in closed form: with sources in the order in
    which a rising level would fill them, all before the first that is not full are full.
    The window holds one row for each source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    everything = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    onward = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", F.get(listed, (F.col("place") - 1) % len(weights)))
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    )
    levels = ranked.withColumn(
        "level",
        (
            F.lit(float(share)) * F.sum("source_size").over(everything)
            - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
        )
        / F.sum("weight").over(onward),
    ).withColumn("open", F.col("level") <= F.col("cap") / F.col("weight"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "place", "level")))
    return levels.withColumn("final", first.over(everything)["level"]).select(
        "source",
        "source_size",
        F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias(
            "target"
        ),
    )


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Whole copies (``base``) and the last hash number of the partial copy, per source.

    ``sized`` has ``source``, ``size`` and ``number``. The threshold leaves the taken tokens
    as near the target as a whole hash value allows; -1 takes nothing of the partial copy.
    """
    whole = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(F.lit(0))
    state = targets.withColumn("base", whole.cast("long")).select(
        F.col("source").alias("of"),
        "source_size",
        "target",
        "base",
        (F.col("target") - F.col("base") * F.col("source_size")).alias("need"),
        F.lit(0).cast("long").alias("prefix"),
    )
    left = 52
    for bits in LEVELS:
        left -= bits
        bucket = F.shiftright("number", left)
        inside = sized.join(
            state.select("of", "prefix", "need"), F.col("source").eqNullSafe(F.col("of"))
        ).where(F.shiftright("number", left + bits) == F.col("prefix"))
        running = Window.partitionBy("of").orderBy("bucket")
        counted = (
            inside.groupBy("of", "need", bucket.alias("bucket"))
            .agg(F.sum("size").alias("tokens"))
            .withColumn("upto", F.sum("tokens").over(running))
        )
        # The boundary bucket is the first that reaches the need.
        edge = counted.groupBy("of").agg(
            F.min(
                F.when(
                    F.col("upto") >= F.col("need"),
                    F.struct("bucket", "tokens", "upto"),
                )
            ).alias("edge"),
            F.max(F.struct("bucket", "tokens", "upto")).alias("last"),
        )
        found = F.coalesce(F.col("edge"), F.col("last"))
        state = stored(
            state.join(
                edge.withColumnRenamed("of", "edge_of"), F.col("of").eqNullSafe(F.col("edge_of")), "left"
            ).select(
                "of",
                "source_size",
                "target",
                "base",
                (F.col("need") - found["upto"] + found["tokens"]).alias("need"),
                found["bucket"].alias("prefix"),
                found["tokens"].alias("tokens"),
            ),
            f"edge{left}",
        )
    # The last bucket is one hash value: in if that is nearer than leaving it out.
    take = F.col("need") * 2 >= F.col("tokens")
    return state.select(
        F.col("of").alias("source"),
        "source_size",
        "target",
        "base",
        F.when(F.col("need") <= 0, F.col("prefix") - 1)
        .when(take, F.col("prefix"))
        .otherwise(F.col("prefix") - 1)
        .alias("threshold"),
    )


def _plan(sized: DataFrame, **settings) -> DataFrame:
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return thresholds(sized, stored(source_targets(sizes, **settings), "targets"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """How many words of each document the mix takes; one row per row of ``docs``.

    Columns ``doc_id``, ``size``, ``source_size``, ``target`` and ``taken``. Settings are those
    of :func:`source_targets`. Null and empty texts have size 0 and take 0; a null source is a
    source of its own, last in order. Rows repeated with the same id and text are taken or left
    together. An empty table gives no rows; further columns are ignored.
    """
    sized = stored(
        docs.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            hash_number(F.col("doc_id"), F.col("text")).alias("number"),
        ),
        "sized",
    )
    plan = _plan(sized, **settings).withColumnRenamed("source", "of")
    copies = F.col("base") + (F.col("number") <= F.col("threshold")).cast("long")
    return sized.join(plan, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken")
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix: a row of ``docs`` stands as often as the mix takes it.

    Documents without words take no part of any budget; they stand once, so that the stage
    after this one sees them.
    """
    names = docs.columns
    row = F.struct(*[F.col(c) for c in names]).alias("row")
    sized = docs.select(
        row,
        F.col("source"),
        word_count(F.col("text")).alias("size"),
        hash_number(F.col("doc_id"), F.col("text")).alias("number"),
    )
    plan = _plan(stored(sized.drop("row"), "sized"), **settings).withColumnRenamed("source", "of")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(
        F.col("base") + (F.col("number") <= F.col("threshold")).cast("long")
    )
    return (
        sized.join(plan, F.col("source").eqNullSafe(F.col("of")), "left")
        .withColumn("copies", copies.cast("int"))
        .where(F.col("copies") > 0)
        .select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
        .select("row.*")
    )


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(concat_ws('|', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), text)), 1, 13)
              AS BIGINT) AS number
  FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) AS place
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][CAST((place - 1) % 3 + 1 AS INTEGER)] AS weight,
         2.0::DOUBLE * source_size AS cap
  FROM sizes),
levels AS (
  SELECT *, cap / weight AS fill,
         (1.5::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, place
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, place
                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
targets AS (
  SELECT source, source_size, t.target,
         CASE WHEN source_size > 0 THEN floor(t.target / source_size) ELSE 0 END AS base
  FROM levels, LATERAL (SELECT least(cap, weight * (
    SELECT arg_min(level, (fill, place)) FROM levels WHERE level <= fill)) AS target) t),
groups AS (
  SELECT source, number, sum(size) AS tokens FROM sized GROUP BY source, number),
running AS (
  SELECT source, number, tokens, sum(tokens) OVER (PARTITION BY source ORDER BY number) AS upto
  FROM groups),
picked AS (
  SELECT r.source, r.number,
         CASE WHEN t.target - t.base * t.source_size > 0
               AND (r.upto <= t.target - t.base * t.source_size
                    OR (r.upto - r.tokens < t.target - t.base * t.source_size
                        AND 2 * (t.target - t.base * t.source_size - (r.upto - r.tokens)) >= r.tokens))
              THEN 1 ELSE 0 END AS more
  FROM running r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT d.doc_id, d.size, t.source_size, t.target,
       CAST(d.size * (t.base + p.more) AS BIGINT) AS taken
FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
JOIN picked p ON d.source IS NOT DISTINCT FROM p.source AND d.number = p.number
"""
