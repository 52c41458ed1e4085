"""Near-duplicates by MinHash with sequential Bayesian verification.

Texts with equal shingle sets form a class. Signatures of the classes are banded; classes
that share a band are candidates. Of each group of candidates, the class with most of them is
a pivot and is compared with the others; what it links is one component. Candidates that are
still in different components meet in tiles of bounded size, and only they. So every candidate
pair is compared, or lies within one component already, and a group of near copies mostly
costs as many comparisons as it has members. A comparison reads the signatures batch by batch
and stops when the posterior probability of a link falls under the chosen miss probability;
survivors are checked on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.functions.columns import named
from tillsight.llm.common import stored, working
from tillsight.llm.graph import components

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
BATCH = 32
WORDS = 2
THRESHOLD = 80
MISS = 1e-6
#: Shingles hashed at once; bounds the memory for long documents.
BLOCK = 4096
#: Classes of a group of candidates that meet as many others in one task.
TILE = 1024

_RNG = np.random.default_rng(20)
_LETTER = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_LETTER[65:91] = _LETTER[97:123]
_GAP = np.isin(np.arange(256), [32, *range(9, 14)])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(256, _STEP, np.uint64))
_FLIPS = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]
_FACTORS = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None] | np.uint32(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers; one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    if n <= len(_POWERS):
        return _POWERS
    return np.cumprod(np.full(n, _STEP, np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, A-Z as a-z; words are runs of anything but white space."""
    codes = np.frombuffer(data, np.uint8)
    inside = ~_GAP[codes]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    first, end = edge[::2], edge[1::2]
    if not len(first):
        return np.empty(0, np.uint64)
    lengths = end - first
    kept = codes[inside]
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(kept)) - np.repeat(begin, lengths)
    return _mix(np.add.reduceat(_LETTER[kept] * _powers(int(lengths.max()))[place], begin))


def shingle_hashes(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text, ``width`` words each.

    A text of fewer words is one shingle, one without words none.
    """
    words = word_hashes((text or "").encode("utf-8", "replace"))
    width = min(width, len(words))
    found = words[: len(words) - width + 1] if width else words
    for k in range(1, width):
        found = _mix(found * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(found)])
    return np.unique(found)


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 2**32 - 1, np.uint32)
    short = shingles.astype(np.uint32)
    for at in range(0, len(short), BLOCK):
        low = np.minimum(low, ((short[None, at : at + BLOCK] ^ _FLIPS) * _FACTORS).min(axis=1))
    return low


def least_matches(threshold: float = THRESHOLD / 100, miss: float = MISS) -> list[int]:
    """For each number of hashes compared, the fewest matches that keep a pair.

    With an even prior, similarity given ``m`` of ``n`` matches is Beta(m + 1, n - m + 1); its
    upper tail is a binomial sum.
    """

    def tail(m: int, n: int) -> float:
        return sum(comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))

    return [
        next(m for m in range(n + 1) if tail(m, n) >= miss)
        for n in range(BATCH, HASHES + 1, BATCH)
    ]


def sketched(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n, key1, key2, signature``: size and identity of each set, and its MinHash."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working("near_dedup")
        for batch in batches:
            n, one, two, signatures = [], [], [], []
            for text in batch["text"]:
                s = shingle_hashes(text, words)
                n.append(len(s))
                one.append(int(_mix(s ^ _STEP).sum(dtype=np.uint64).astype(np.int64)))
                two.append(int(_mix(s + _STEP).sum(dtype=np.uint64).astype(np.int64)))
                signatures.append(signature(s).tobytes())
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"].astype("Int64"), "n": n, "key1": one, "key2": two, "signature": signatures}
            )

    kind = "doc_id long, n long, key1 long, key2 long, signature binary"
    return docs.select("doc_id", "text").mapInPandas(sketch, kind)


def set_arrays(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``id`` and ``text`` to ``id`` and the array of shingle hashes."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_hashes(t, words).view(np.int64) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "set": sets})

    return texts.mapInPandas(gather, "id long, set array<long>")


def survives(left: Column, right: Column, needed: list[int]) -> Column:
    """Whether a pair of signatures passes every batch of the sequential test."""

    @F.pandas_udf("boolean")
    def passed(a: pd.Series, b: pd.Series) -> pd.Series:
        one = np.frombuffer(b"".join(a), np.uint32).reshape(-1, HASHES)
        two = np.frombuffer(b"".join(b), np.uint32).reshape(-1, HASHES)
        alive, matches = np.arange(len(one)), np.zeros(len(one), np.int64)
        for k, least in enumerate(needed):
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches = matches + (one[alive, part] == two[alive, part]).sum(axis=1)
            keep = matches >= least
            alive, matches = alive[keep], matches[keep]
        found = np.zeros(len(one), bool)
        found[alive] = True
        return pd.Series(found)

    return passed(left, right)


def _links(pairs: DataFrame, signatures: DataFrame, sets: DataFrame, threshold: int, miss: float) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough."""
    needed = least_matches(threshold / 100, miss)

    def side(table: DataFrame, name: str, value: str) -> DataFrame:
        return table.select(F.col("id").alias(name), F.col(value).alias(f"{value}_{name}"))

    close = (
        pairs.join(side(signatures, "a", "signature"), "a")
        .join(side(signatures, "b", "signature"), "b")
        .where(survives(F.col("signature_a"), F.col("signature_b"), needed))
        .select("a", "b")
    )
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    return (
        close.join(side(sets, "a", "set"), "a")
        .join(side(sets, "b", "set"), "b")
        .where(shared * 100 >= union * threshold)
        .select("a", "b")
    )


def _sized(threshold: int) -> Column:
    """Sizes of two sets that leave room for the similarity."""
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * threshold


def linked_classes(
    classes: DataFrame,
    docs: DataFrame,
    words: int = WORDS,
    threshold: int = THRESHOLD,
    miss: float = MISS,
) -> DataFrame:
    """``id`` and ``label`` of the classes that are linked; ``classes`` has ``id, n, signature``."""
    keys = [
        F.xxhash64(F.lit(band), F.substring("signature", 4 * ROWS * band + 1, 4 * ROWS))
        for band in range(BANDS)
    ]
    banded = classes.select("id", "n", F.explode(F.array(*keys)).alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    grouped = stored(banded.join(shared, "key"), "grouped")
    # How many candidates a class has over all bands: the text that others are copies of
    # has most of them, and as a pivot it links most.
    ids = stored(grouped.groupBy("id").agg(F.sum("members").alias("degree")), "degrees")
    ranked = grouped.join(ids, "id").select("key", "id", "n", "degree")
    first = F.max(F.struct("degree", (-F.col("id")).alias("order"), "id", "n")).alias("pivot")
    pivots = ranked.groupBy("key").agg(first)
    members = stored(ranked.join(pivots, "key"), "members")
    signatures = stored(classes.join(ids, "id", "left_semi").select("id", "signature"), "signatures")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")
    sets = stored(set_arrays(texts, words), "sets")

    stars = members.where(F.col("id") != F.col("pivot.id")).select(
        F.col("pivot.id").alias("a"), F.col("id").alias("b"),
        F.col("pivot.n").alias("n_a"), F.col("n").alias("n_b"),
    )
    pairs = stars.where(_sized(threshold)).select("a", "b").distinct()
    labels = stored(components(_links(pairs, signatures, sets, threshold, miss)), "labels")
    # Pivots have met all others of their group and need not come again.
    active = members.where(F.col("id") != F.col("pivot.id")).select("key", "id", "n")
    named = active.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "label", F.coalesce("label", "id")
    )
    split = named.groupBy("key").agg(F.min("id").alias("head"), F.min("label").alias("low"), F.max("label").alias("high"))
    open_ = stored(named.join(split.where("low < high"), "key").select("id", "n", "label", "head"), "open")
    unchecked = stored(components(open_.select(F.col("id").alias("a"), F.col("head").alias("b"))), "unchecked")
    rows = (
        open_.select("id", "n", "label").distinct()
        .join(unchecked.select(F.col("node").alias("id"), F.col("label").alias("group")), "id")
        .join(signatures, "id")
        .join(sets, "id")
    )
    edges = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    found = stored(_met(stored(rows, "rows"), threshold, miss), "found")
    return components(edges.unionByName(found)).withColumnRenamed("node", "id")


def _met(rows: DataFrame, threshold: int, miss: float) -> DataFrame:
    """Links ``a, b`` that join components within a group of candidates.

    The largest component of a group is its main one. All others meet each other and the main
    one, in tiles of bounded size, so a group of any size is spread over tasks; the main one is
    not compared with itself. A tile gives no more links than join its components.
    """
    sizes = rows.groupBy("group", "label").agg(F.count(F.lit(1)).alias("rows"))
    top = F.max(F.struct("rows", "label"))
    tiles = sizes.groupBy("group").agg(
        top["label"].alias("main"),
        F.ceil((F.sum("rows") - top["rows"]) / TILE).cast("int").alias("others"),
        F.ceil(top["rows"] / TILE).cast("int").alias("mains"),
    )
    outside = F.col("label") != F.col("main")
    dealt = rows.join(tiles, "group").withColumn(
        "tile",
        F.pmod(F.xxhash64("id"), F.when(outside, F.col("others")).otherwise(F.col("mains"))).cast("int")
        + F.when(outside, 0).otherwise(F.col("others")),
    )
    # Under aliases, the two sides of the same rows are columns of their own.
    columns = [F.col(c).alias(c) for c in ("group", "id", "n", "label", "signature", "set")]
    last = F.col("others") - 1
    left = dealt.where(outside).select(
        *columns, F.col("tile").alias("one"),
        F.explode(F.sequence("tile", last + F.col("mains"))).alias("two"),
    )
    right = dealt.select(
        *columns, F.explode(F.sequence(F.lit(0), F.least("tile", last))).alias("one"), F.col("tile").alias("two")
    )
    needed = least_matches(threshold / 100, miss)

    def meet(key: tuple, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        pairs = _joining(one, two, key[1] == key[2], needed, threshold) if len(one) and len(two) else []
        return pd.DataFrame(pairs, columns=["a", "b"]).astype("int64")

    by = ["group", "one", "two"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(meet, "a long, b long")


def _joining(one: pd.DataFrame, two: pd.DataFrame, same: bool, needed: list[int], threshold: int) -> list:
    """Similar pairs of two tiles that join components, by sequential test and full sets."""
    sketch = [np.frombuffer(b"".join(t["signature"]), np.uint32).reshape(-1, HASHES) for t in (one, two)]
    ids, sizes, labels = (two[c].to_numpy() for c in ("id", "n", "label"))
    shingles = np.concatenate([np.asarray(s) for s in two["set"]])
    owner = np.repeat(np.arange(len(two)), [len(s) for s in two["set"]])
    order = np.argsort(shingles, kind="stable")
    owner = owner[order]
    known, first = np.unique(shingles[order], return_index=True)
    end = np.append(first[1:], len(shingles))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    pairs = []
    for id_, size, label, signed, own in zip(one["id"], one["n"], one["label"], sketch[0], one["set"]):
        alive = (labels != label) & (np.minimum(sizes, size) * 100 >= np.maximum(sizes, size) * threshold)
        if same:
            alive &= ids > id_
        alive = np.flatnonzero(alive)
        matches = np.zeros(len(alive), np.int64)
        for k, least in enumerate(needed):
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches = matches + (sketch[1][alive, part] == signed[part]).sum(axis=1)
            alive, matches = alive[matches >= least], matches[matches >= least]
        if not len(alive):
            continue
        own = np.asarray(own)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        at = at[known[at] == own]
        holders = [owner[first[i] : end[i]] for i in at]
        shared = np.bincount(np.concatenate(holders) if holders else [], minlength=len(two))[alive]
        for other in alive[shared * 100 >= (size + sizes[alive] - shared) * threshold]:
            a, b = find(int(label)), find(int(labels[other]))
            if a != b:
                root[max(a, b)] = min(a, b)
                pairs.append((int(id_), int(ids[other])))
    return pairs


def near_duplicates(
    docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, miss: float = MISS
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Documents are linked if 100 times the shared shingles of ``words`` words reach
    ``threshold`` times the union.
    Null texts and texts without words have no shingles and are linked with nothing. A row with
    a null id is linked with nothing, has no component and is kept. Rows with one id count as
    one document, whatever their texts. An empty table gives no rows; further columns are
    ignored.
    """
    sketches = stored(sketched(docs, words), "sketches")
    usable = sketches.where("n > 0 AND doc_id IS NOT NULL")
    classes = stored(
        usable.groupBy("key1", "key2").agg(
            F.min("doc_id").alias("id"), F.min("n").alias("n"), F.first("signature").alias("signature")
        ),
        "classes",
    )
    labels = linked_classes(classes.select("id", "n", "signature"), docs, words, threshold, miss)
    # A class without copies whose document is its own component needs no row here.
    known = classes.select("key1", "key2", "id").join(labels, "id", "left").select(
        "key1", "key2", F.coalesce("label", "id").alias("label")
    )
    own = F.when(F.col("n") > 0, F.col("label"))
    return sketches.drop("signature").join(known, ["key1", "key2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce(own, F.col("doc_id"))).alias("component_id"),
    ).withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    )


def keep_one(
    docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, miss: float = MISS
) -> DataFrame:
    """One document of each component, with all columns.

    Of repeated rows with one id, that of the smallest text stays, and of equal texts the first
    by the other columns as JSON. Null and empty texts are alike to nothing and stay, and so do
    rows without an id.
    """
    kept = near_duplicates(docs, words, threshold, miss).where("kept AND doc_id IS NOT NULL")
    kept = kept.select("doc_id").distinct()
    others = [named(c) for c in docs.columns if c not in ("doc_id", "text")]
    order = F.struct("text", *([F.to_json(F.struct(*others))] if others else []))
    first = (
        docs.join(kept, "doc_id", "left_semi")
        .select(F.col("doc_id").alias("of"), F.struct("*").alias("row"), order.alias("order"))
        .groupBy("of")
        .agg(F.min_by("row", "order").alias("row"))
        .select("row.*")
    )
    return first.unionByName(docs.where("doc_id IS NULL"))


NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) = 1 THEN w
    ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * common >= 80 * (p.n + q.n - common)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT a, b FROM both_ways
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
least_of AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles,
       least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""
