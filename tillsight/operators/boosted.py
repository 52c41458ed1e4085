"""Boosted trees as a third candidate, for any number of series in one job.

A series is at most some hundred months, so it is one row of arrays, and a task grows the trees
of all its rows together with numpy: least-squares boosting with exact splits, between any two
neighbouring values of a feature. Every tree sees the same share of the months, picked anew for
each tree by a fixed seed. Other libraries draw their samples otherwise, so the numbers agree
with theirs in kind and not digit by digit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.functions.columns import named
from tillsight.operators import forecast as fc

BOOSTED = "gbr_seasonal"


@dataclass(frozen=True)
class Settings:
    # The settings of the boosted candidate.
    trees: int = 35
    depth: int = 3
    rate: float = 0.08
    sampled: float = 0.9
    seed: int = 42


SETTINGS = Settings()

#: A prime beyond the length of any series, and factors of seed and tree, for the samples.
PRIME, SEEDS, TREES = 1_000_003, 7919, 104_729
#: Values nearer than this are the same to a split.
SAME = 1e-7
#: A later feature must gain more than this share over an earlier one.
GAIN = 1e-9


def sampled_months(months: int, tree: int, settings: Settings = SETTINGS) -> np.ndarray:
    """Which of the months a tree sees: those with the smallest multiples, modulo a prime."""
    factor = (settings.seed * SEEDS + (tree + 1) * TREES) % PRIME
    drawn = np.arange(1, months + 1, dtype=np.int64) * factor % PRIME
    seen = np.zeros(months, bool)
    seen[np.argsort(drawn)[: max(1, int(settings.sampled * months))]] = True
    return seen


def boosted_values(
    x: np.ndarray, y: np.ndarray, months: int, settings: Settings = SETTINGS
) -> np.ndarray:
    """Predictions at all points of ``x`` by models of the first ``months``, a row per series.

    ``x`` is series by points by features, ``y`` series by points.
    """
    known, learn = x[:, :months], y[:, :months]
    order = np.argsort(known, axis=1, kind="stable")
    values = np.take_along_axis(known, order, axis=1)
    level = learn.mean(axis=1, keepdims=True)
    least = fc.FLAT_TOLERANCE * (learn**2).sum(axis=1)
    predicted = np.repeat(level, x.shape[1], axis=1)
    each = np.arange(len(x))
    for tree in range(settings.trees):
        rest = learn - predicted[:, :months]
        seen = sampled_months(months, tree, settings)
        node = np.zeros(x.shape[:2], np.int64)
        for depth in range(settings.depth):
            feature = np.zeros((len(x), 2**depth), np.int64)
            limit = np.full((len(x), 2**depth), np.inf)
            for number in range(2**depth):
                inside = seen & (node[:, :months] == number)
                best = least.copy()
                for f in range(x.shape[2]):
                    gain, cut = _best_cut(values[:, :, f], order[:, :, f], inside, rest)
                    better = gain > best + GAIN * np.abs(best)
                    best = np.where(better, gain, best)
                    feature[better, number], limit[better, number] = f, cut[better]
            chosen = x[each[:, None], np.arange(x.shape[1]), feature[each[:, None], node]]
            node = 2 * node + (chosen > limit[each[:, None], node])
        for leaf in range(2**settings.depth):
            inside = seen & (node[:, :months] == leaf)
            mean = (rest * inside).sum(axis=1) / np.maximum(inside.sum(axis=1), 1)
            predicted += settings.rate * mean[:, None] * (node == leaf)
    return predicted


def _best_cut(
    values: np.ndarray, order: np.ndarray, inside: np.ndarray, rest: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Gain and threshold of each series' best split by one feature, among the rows ``inside``."""
    member = np.take_along_axis(inside, order, axis=1)
    amount = np.where(member, np.take_along_axis(rest, order, axis=1), 0.0)
    left, left_sum = member.cumsum(axis=1), amount.cumsum(axis=1)
    right, right_sum = left[:, -1:] - left, left_sum[:, -1:] - left_sum
    later = np.where(member, values, np.inf)
    later = np.minimum.accumulate(later[:, ::-1], axis=1)[:, ::-1]
    later = np.concatenate([later[:, 1:], np.full((len(values), 1), np.inf)], axis=1)
    valid = member & (right > 0) & (later > values + SAME)
    halves = left_sum**2 / np.maximum(left, 1) + right_sum**2 / np.maximum(right, 1)
    whole = left_sum[:, -1:] ** 2 / np.maximum(left[:, -1:], 1)
    gain = np.where(valid, halves - whole, -np.inf)
    at = gain.argmax(axis=1)[:, None]
    cut = (np.take_along_axis(values, at, 1) + np.take_along_axis(later, at, 1))[:, 0] / 2
    return np.take_along_axis(gain, at, 1)[:, 0], cut


def folds_of(n: int) -> tuple[list[int], int]:
    """First months of the test blocks of a series and their length."""
    count = min(fc.MOST_FOLDS, n // 4) if n >= fc.FULL_CV_LENGTH else 0
    size = n // (count + 1)
    return [n - (count - fold) * size for fold in range(count)], size


def fit_quality(y: np.ndarray, predicted: np.ndarray, level: np.ndarray) -> np.ndarray:
    """R² per series; without any variance 1 for an exact fit and 0 otherwise."""
    residual = ((y - predicted) ** 2).sum(axis=1)
    spread = ((y - y.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
    nothing = fc.FLAT_TOLERANCE * y.shape[1] * level**2
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(spread > nothing, 1 - residual / spread, np.where(residual <= nothing, 1.0, 0.0))


def fitted(
    months: list[np.ndarray], y: list[np.ndarray], ahead: int, settings: Settings = SETTINGS
) -> list[tuple]:
    """``(score, r2, predictions ahead)`` of series; ``months`` go on ``ahead`` beyond ``y``.

    Series of one length are fitted together. Those of fewer than two months have no model.
    """
    out: list[tuple] = [(None, None, None)] * len(y)
    lengths = np.array([len(one) for one in y])
    for n in np.unique(lengths[lengths >= 2]):
        of = np.flatnonzero(lengths == n)
        values = np.array([y[i] for i in of], float)
        angle = 2 * np.pi * np.array([months[i] for i in of], float) / 12
        time = np.broadcast_to(np.arange(n + ahead, dtype=float), angle.shape)
        x = np.stack([time, np.sin(angle), np.cos(angle)], axis=2)
        level = values.mean(axis=1)
        whole = boosted_values(x, values, n, settings)
        r2 = fit_quality(values, whole[:, :n], level)
        starts, size = folds_of(int(n))
        tested = [
            fit_quality(
                values[:, start : start + size],
                boosted_values(x[:, : start + size], values, start, settings)[:, start:],
                level,
            )
            for start in starts
        ]
        score = np.mean(tested, axis=0) if tested else r2
        for place, i in enumerate(of):
            out[i] = (float(score[place]), float(r2[place]), np.maximum(whole[place, n:], 0).tolist())
    return out


def boosted_candidates(
    series: DataFrame,
    keys: Sequence[str] = (),
    horizon: int = fc.HORIZON,
    settings: Settings = SETTINGS,
) -> DataFrame:
    """The boosted candidate of every series, in the form of :func:`forecast.fit_candidates`.

    ``ahead`` holds its predictions for the next ``horizon`` months in place of coefficients.
    """

    @F.pandas_udf("score double, r2 double, ahead array<double>")
    def fit(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for months, y in batches:
            rows = fitted(list(months), list(y), horizon, settings)
            yield pd.DataFrame(rows, columns=["score", "r2", "ahead"])

    in_order = F.array_sort(F.collect_list(F.struct("period", "month_num", "y")))
    per_key = series.groupBy(*[named(k) for k in keys]).agg(in_order.alias("points"))
    last = F.element_at("points", -1)
    steps = F.sequence(F.lit(1), F.lit(horizon))
    # An unkeyed empty series is one row without points.
    shaped = per_key.select(
        *[named(k) for k in keys],
        F.size("points").cast("bigint").alias("n"),
        F.when(F.size("points") > 0, last).alias("last"),
        F.col("points")["month_num"].cast("array<int>").alias("months"),
        F.col("points")["y"].alias("values"),
    ).withColumn(
        "months",
        F.when(F.col("n") == 0, F.array().cast("array<int>")).otherwise(
            F.concat("months", F.transform(steps, lambda s: fc.future_month(F.col("last.month_num"), s)))
        ),
    )
    return shaped.withColumn("fit", fit("months", "values")).select(
        *[named(k) for k in keys],
        "n",
        F.col("last.y").alias("last_y"),
        F.col("last.period").alias("last_period"),
        F.col("last.month_num").alias("last_month"),
        F.lit(len(fc.PENALTIES)).alias("candidate_order"),
        F.lit(BOOSTED).alias("model"),
        F.col("fit.score").alias("score"),
        F.col("fit.r2").alias("r2"),
        F.col("fit.ahead").alias("ahead"),
    )


def pick_of_three(
    series: DataFrame, keys: Sequence[str] = (), horizon: int = fc.HORIZON
) -> DataFrame:
    """The best of ridge, least squares and boosted trees for every series, in one job.

    The candidates keep their order of preference: boosted trees must score higher than the
    other two to be chosen.
    """
    linear = fc.fit_candidates(series, keys)
    boosted = boosted_candidates(series, keys, horizon)
    return fc.pick_model(linear.unionByName(boosted, allowMissingColumns=True), keys)


def boosted_forecast(
    series: DataFrame,
    keys: Sequence[str] = (),
    horizon: int = fc.HORIZON,
    calendar: bool = True,
) -> DataFrame:
    """Forecasts by the boosted candidate alone: (step, label, month_num, forecast, score, r2)."""
    candidates = boosted_candidates(series, keys, horizon)
    for name in ("intercept", "slope", "coef_sin", "coef_cos"):
        candidates = candidates.withColumn(name, F.lit(None).cast("double"))
    picked = fc.pick_model(candidates, keys)
    return fc.forecast_points(picked, keys, horizon, calendar, carry=("score", "r2"))
