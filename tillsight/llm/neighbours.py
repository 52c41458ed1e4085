"""Approximate nearest neighbours by collision counting with query-aware windows.

Vectors of length one are projected on random directions. For each direction a block of
vectors is one sorted array of projections. A query's window around its own projection grows
step by step (virtual rehashing); a vector collides where it lies in the window. Vectors that
collide in enough directions are verified by their exact cosine. Windows grow until a set
share of the block is verified, so every block of every size gives its own nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEAREST = 5
#: Vectors of an index block, or eight times as many where there would be more blocks than this.
BLOCK, BLOCKS = 8192, 64
#: Queries that meet a block in one task.
QUERY_BLOCK = 1 << 16
#: Queries of a block whose windows grow together.
GROUP = 128
#: Vectors from which the first window is fitted.
SAMPLE = 2000


@dataclass(frozen=True)
class Search:
    """Directions; share of them that must collide; share of a block to verify; growth."""

    directions: int = 96
    collide: float = 0.5
    verify: float = 0.2
    grow: float = 1.12
    seed: int = 5

    def basis(self, dim: int) -> np.ndarray:
        """Random directions, orthogonal within each set of ``dim``."""
        rng, sets = np.random.default_rng([self.seed, dim]), []
        for _ in range(-(-self.directions // dim)):
            sets.append(np.linalg.qr(rng.normal(size=(dim, dim)))[0])
        return np.concatenate(sets, axis=1)[:, : self.directions].astype(np.float32)


def candidates(
    index: np.ndarray, queries: np.ndarray, search: Search, width: float, least: int
) -> Iterator[np.ndarray]:
    """For each query, the numbers of the vectors of the block that collide often enough.

    ``index`` and ``queries`` are projections, a row for each vector. ``least`` is how many
    vectors must reach the collision threshold before a query stops. All queries of a group grow
    their windows by the same steps, so the ends of the windows are found for all at once.
    """
    n, m = index.shape
    order = np.argsort(index, axis=0, kind="stable").T.copy()
    ranked = np.take_along_axis(index.T, order, axis=1)
    needed = max(1, int(np.ceil(search.collide * m)))
    least = min(least, n)
    for at in range(0, len(queries), GROUP):
        group = queries[at : at + GROUP].T
        counts = np.zeros((group.shape[1], n), np.int32)
        found: list[np.ndarray | None] = [None] * len(counts)
        open_ = np.arange(len(counts))
        low = high = _ends(ranked, group, "left")
        half = width
        while len(open_):
            new_low = _ends(ranked, group[:, open_] - half, "left")
            new_high = _ends(ranked, group[:, open_] + half, "right")
            for j, q in enumerate(open_):
                ring = [order[i, new_low[i, j] : low[i, j]] for i in range(m)]
                ring += [order[i, high[i, j] : new_high[i, j]] for i in range(m)]
                counts[q] += np.bincount(np.concatenate(ring), minlength=n)
            enough = (counts[open_] >= needed).sum(axis=1) >= least
            done = enough | (new_low == 0).all(axis=0) & (new_high == n).all(axis=0)
            for q in open_[done]:
                found[q] = np.flatnonzero(counts[q] >= needed)
            open_, low, high = open_[~done], new_low[:, ~done], new_high[:, ~done]
            half *= search.grow
        yield from found


def _ends(ranked: np.ndarray, places: np.ndarray, side: str) -> np.ndarray:
    return np.stack([np.searchsorted(row, at, side) for row, at in zip(ranked, places)])


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, dim, unit``: vectors of length one, in double precision.

    Leaves out null and zero vectors, those with null, infinite or undefined components, and
    rows without an id.
    """
    values = F.col("embedding").cast("array<double>")
    sound = F.forall(
        values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))
    return (
        vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull())
        .where(sound)
        .select("vec_id", values.alias("values"), length.alias("length"))
        .where((F.col("length") > 0) & (F.col("length") < float("inf")))
        .select("vec_id", F.size("values").alias("dim"), "values")
    )


def first_width(units: DataFrame, search: Search, sample: int = SAMPLE) -> dict[int, float]:
    """Half the width of the first window for each dimension, from a bounded sample.

    The width at which a tenth of the sampled pairs would be candidates; windows grow from
    there, so the sample moves the start of the search and not its end.
    """
    picked = units.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    widths = {}
    for dim, rows in picked.groupby("dim"):
        x = _unit(np.stack(rows["values"])) @ search.basis(int(dim))
        far = np.abs(x[: len(x) // 2] - x[len(x) // 2 : 2 * (len(x) // 2)])
        reach = np.quantile(far, search.collide, axis=1) if len(far) else np.array([0.1])
        widths[int(dim)] = float(max(1e-6, np.quantile(reach, 0.1)))
    return widths


def _unit(values: np.ndarray) -> np.ndarray:
    return (values / np.linalg.norm(values, axis=1, keepdims=True)).astype(np.float32)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = NEAREST, search: Search = Search()
) -> DataFrame:
    """The ``k`` vectors nearest to each query by cosine, the query's own id left out.

    Columns ``query_id``, ``rank`` from 1, ``vec_id``, ``score``. Both tables have ``vec_id``
    and ``embedding``. Vectors that are null, zero, or hold null or non-finite components take
    no part; vectors meet queries of their own dimension only. Ties go to the smaller id.
    Of repeated rows with one id, the nearest counts once. Without vectors or queries there
    are no rows; further columns are ignored. Candidates are found approximately; scores are
    exact.
    """
    units, asked = usable(vectors), usable(queries)
    sizes = units.groupBy("dim").count().collect()
    widths = first_width(units, search)
    # Every block meets all queries, so of many vectors the blocks are larger.
    most = max([1, *(r["count"] for r in sizes)])
    blocks = -(-most // min(max(BLOCK, -(-most // BLOCKS)), 8 * BLOCK))
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    left = units.select(
        "vec_id", "dim", "values",
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
    )
    right = asked.select(
        F.col("vec_id").alias("query_id"), "dim", "values",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.pmod(F.xxhash64("vec_id", F.lit("part")), F.lit(parts)).cast("int").alias("part"),
    )

    def look(index: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(wanted):
            index = index.sort_values("vec_id", kind="stable")
            dim = int(index["dim"].iloc[0])
            values, asked = np.stack(index["values"]), np.stack(wanted["values"])
            basis = search.basis(dim)
            one, two = _unit(values) @ basis, _unit(asked) @ basis
            least = k + 1 + int(np.ceil(search.verify * len(values)))
            lengths = np.linalg.norm(values, axis=1)
            ids = index["vec_id"].to_numpy()
            found = candidates(one, two, search, widths.get(dim, 0.1), least)
            for query, vector, near in zip(wanted["query_id"], asked, found):
                near = near[ids[near] != query]
                score = values[near] @ vector / (lengths[near] * np.linalg.norm(vector))
                best = np.lexsort((ids[near], -score))
                rows = pd.DataFrame({"vec_id": ids[near][best], "score": score[best]})
                rows = rows.drop_duplicates("vec_id").head(k)
                rows.insert(0, "query_id", query)
                out.append(rows)
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"}
            )
        return pd.concat(out, ignore_index=True)

    keys = ["dim", "block", "part"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        look, "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
