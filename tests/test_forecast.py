"""Forecasts against a plain numpy version fitted series by series."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tillsight.operators import boosted
from tillsight.operators import forecast as fc

KEYS = ["key"]


def design(t, months):
    angle = 2 * np.pi * np.asarray(months, float) / 12
    return np.column_stack([np.asarray(t, float), np.sin(angle), np.cos(angle)])


def fit(x, y, alpha):
    level, centre = y.mean(), x.mean(axis=0)
    xc, yc = x - centre, y - level
    if alpha:
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    else:
        w = np.linalg.lstsq(xc, yc, rcond=1e-9)[0]
    return w, level - centre @ w


def r2(y, p):
    spread, residual = ((y - y.mean()) ** 2).sum(), ((y - p) ** 2).sum()
    if spread <= 1e-20 * (y**2).sum():
        return 1.0 if residual <= 1e-20 * (y**2).sum() else 0.0
    return 1 - residual / spread


def score(x, y, alpha):
    n = len(y)
    if n < 8:
        w, b = fit(x, y, alpha)
        return r2(y, x @ w + b)
    k = min(3, n // 4)
    size = n // (k + 1)
    scores = []
    for start in range(n - k * size, n, size):
        w, b = fit(x[:start], y[:start], alpha)
        scores.append(r2(y[start : start + size], x[start : start + size] @ w + b))
    return float(np.mean(scores))


def expected(values, months, horizon=3):
    y, n = np.asarray(values, float), len(values)
    if n == 1:
        return "fallback", 75.0, 0.0, [y[0]]
    x = design(range(n), months)
    scores = {"ridge_seasonal": score(x, y, 8.0), "linear_seasonal": score(x, y, 0.0)}
    model = "linear_seasonal" if scores["linear_seasonal"] > scores["ridge_seasonal"] else "ridge_seasonal"
    w, b = fit(x, y, 8.0 if model == "ridge_seasonal" else 0.0)
    accuracy = max(0.0, min(99.0, r2(y, x @ w + b) * 100))
    ahead = [(months[-1] + i) % 12 + 1 for i in range(horizon)]
    values = np.maximum(0, design(range(n, n + horizon), ahead) @ w + b)
    trend = (values[0] - y[-1]) / y[-1] * 100 if y[-1] > 0 else 0.0
    return model, accuracy, trend, list(values)


def months_from(first, n, step=1):
    start = first.year * 12 + first.month - 1
    return [datetime.date((start + i * step) // 12, (start + i * step) % 12 + 1, 1) for i in range(n)]


def build():
    rng = np.random.default_rng(3)
    series = {}
    for n in (1, 2, 3, 4, 5, 7, 8, 9, 11, 12, 13, 37, 80):
        days = months_from(datetime.date(2019, 5, 1), n)
        season = [30 * math.sin(2 * math.pi * d.month / 12) for d in days]
        series[f"n{n}"] = (days, [round(200 + 3 * i + s + rng.normal(0, 8), 2) for i, s in enumerate(season)])
    days = months_from(datetime.date(2020, 1, 1), 20)
    series["flat"] = (days, [0.1] * 20)
    series["zeros"] = (days, [0.0] * 20)
    series["falling"] = (days, [100.0 - 9 * i for i in range(20)])
    series["negative"] = (days, [-5.0 - i for i in range(20)])
    series["gaps"] = (days[:4] + days[9:], [50.0 + 7 * (i % 5) for i in range(15)])
    series["same_month"] = (months_from(datetime.date(2000, 3, 1), 10, 12), [5.0 + i * i for i in range(10)])
    series["two_same"] = (months_from(datetime.date(2000, 3, 1), 2, 12), [5.0, 9.0])
    series["large"] = (months_from(datetime.date(2015, 1, 1), 60), [1e13 + 1e8 * (i % 7) + 1e7 * i for i in range(60)])
    return series


SERIES = build()


@pytest.fixture(scope="module")
def series(spark):
    data = [(k, d, float(y), d.month) for k, (days, ys) in SERIES.items() for d, y in zip(days, ys)]
    return spark.createDataFrame(data, "key string, period date, y double, month_num int")


@pytest.fixture(scope="module")
def summaries(series):
    found = fc.forecast_summary(fc.pick_for(series, KEYS), KEYS).collect()
    return {row["key"]: row for row in found}


@pytest.fixture(scope="module")
def points(series):
    found = {}
    for row in fc.forecast(series, KEYS).orderBy("key", "step").collect():
        found.setdefault(row["key"], []).append(row)
    return found


@pytest.mark.parametrize("key", sorted(SERIES))
def test_forecast_equals_numpy(summaries, points, key):
    days, values = SERIES[key]
    model, accuracy, trend, ahead = expected(values, [d.month for d in days])
    summary = summaries[key]
    assert summary["n"] == len(values)
    assert summary["model"] == model
    assert math.isclose(summary["forecast_accuracy"], accuracy, abs_tol=0.051)
    assert math.isclose(summary["forecast_trend"], trend, abs_tol=0.051, rel_tol=1e-6)
    assert summary["trend_class"] == ("up" if trend >= 0 else "down")
    assert [p["forecast"] for p in points[key]] == pytest.approx(ahead, abs=0.0051, rel=1e-9)
    assert summary["forecast_value"] == points[key][0]["forecast"]


def test_labels_follow_the_calendar(points):
    assert [p["label"] for p in points["n8"]] == ["Jan 2020", "Feb 2020", "Mar 2020"]
    assert [p["label"] for p in points["n1"]] == ["Next Period"]
    assert [(p["month_num"], p["label"]) for p in points["n7"]] == [
        (12, "Dec 2019"), (1, "Jan 2020"), (2, "Feb 2020"),
    ]


def test_bounds(summaries, points):
    assert all(0 <= s["forecast_accuracy"] <= 99 for s in summaries.values())
    assert all(p["forecast"] >= 0 for found in points.values() for p in found)
    assert summaries["negative"]["forecast_trend"] == 0.0


@pytest.mark.parametrize("key", ["n8", "n9", "n12", "n37", "n80", "same_month"])
def test_folds(series, key):
    n = len(SERIES[key][1])
    k = min(3, n // 4)
    size = n // (k + 1)
    found = fc.cross_validation(series.where(F.col("key") == key), KEYS)
    folds = sorted({(r["fold"], r["train_months"], r["test_months"]) for r in found.collect()})
    assert folds == [(j, n - (k - j + 1) * size, size) for j in range(1, k + 1)]


def test_short_series_are_not_cut(series):
    assert fc.cross_validation(series.where(F.col("key") == "n7"), KEYS).count() == 0


@pytest.mark.parametrize("model, alpha", [(fc.RIDGE, 8.0), (fc.LINEAR, 0.0)])
def test_coefficients(series, model, alpha):
    found = {r["key"]: r for r in fc.fit_one(series, model, KEYS).collect()}
    for key in ("n8", "n37", "n80", "gaps", "large"):
        days, values = SERIES[key]
        w, b = fit(design(range(len(days)), [d.month for d in days]), np.array(values), alpha)
        row = found[key]
        assert [row["slope"], row["coef_sin"], row["coef_cos"], row["intercept"]] == pytest.approx(
            [*w, b], rel=1e-6
        )


def test_missing_months_leave_no_gap_in_the_index(series):
    found = fc.series_index(series.where(F.col("key") == "gaps"), KEYS).orderBy("period")
    assert [r["t"] for r in found.collect()] == list(range(15))


def test_one_series_without_a_key(series):
    one = series.where(F.col("key") == "n37").drop("key")
    summary = fc.forecast_summary(fc.pick_for(one)).first()
    model, _, _, ahead = expected(SERIES["n37"][1], [d.month for d in SERIES["n37"][0]])
    assert summary["model"] == model
    assert summary["forecast_value"] == pytest.approx(ahead[0], abs=0.0051)


def test_no_months_at_all(series):
    picked = fc.pick_for(series.where("false").drop("key"))
    assert rows(fc.forecast_summary(picked)) == [(0, "none", 0.0, 0.0, 0.0, "up")]
    assert fc.forecast_points(picked).count() == 0
    assert fc.forecast(series.where("false"), KEYS).count() == 0


def test_labels_without_a_calendar(series):
    one = fc.pick_for(series.where(F.col("key") == "n8").drop("key"))
    found = fc.forecast_points(one, horizon=2, calendar=False)
    assert [r["label"] for r in found.collect()] == ["Next +1", "Next +2"]


def grown(x, r, rows, depth, least):
    """A regression tree by trying every split, as a function of a point."""
    mean = r[rows].mean() if len(rows) else 0.0
    best = (least, None, None)
    for f in range(3):
        values = sorted(set(x[rows, f]))
        for low, high in zip(values, values[1:]):
            if high - low <= boosted.SAME:
                continue
            left = [i for i in rows if x[i, f] <= (low + high) / 2]
            right = [i for i in rows if x[i, f] > (low + high) / 2]
            gain = r[left].sum() ** 2 / len(left) + r[right].sum() ** 2 / len(right) - r[rows].sum() ** 2 / len(rows)
            if gain > best[0] * (1 + boosted.GAIN):
                best = (gain, f, (low + high) / 2)
    if depth == 0 or best[1] is None:
        return lambda p: mean
    _, f, cut = best
    sides = [grown(x, r, [i for i in rows if (x[i, f] > cut) == side], depth - 1, least) for side in (False, True)]
    return lambda p: sides[int(p[f] > cut)](p)


def boosted_plainly(x, y, n, settings):
    level = y[:n].mean()
    found = np.full(len(x), level)
    least = fc.FLAT_TOLERANCE * (y[:n] ** 2).sum()
    for number in range(settings.trees):
        seen = np.flatnonzero(boosted.sampled_months(n, number, settings))
        tree = grown(x[:n], y[:n] - found[:n], list(seen), settings.depth, least)
        found = found + settings.rate * np.array([tree(p) for p in x])
    return found


@pytest.mark.parametrize("settings", [boosted.Settings(sampled=1.0), boosted.SETTINGS, boosted.Settings(trees=5, depth=2)])
def test_trees_equal_a_search_of_all_splits(settings):
    rng = np.random.default_rng(4)
    for n in (2, 3, 7, 13, 30):
        months = np.array([[(s + i) % 12 + 1 for i in range(n + 3)] for s in (0, 4, 9)])
        x = np.stack([design(range(n + 3), m) for m in months])
        y = rng.normal(100, 20, (3, n))
        found = boosted.boosted_values(x, y, n, settings)
        for k in range(3):
            assert found[k] == pytest.approx(boosted_plainly(x[k], y[k], n, settings), rel=1e-9)


def test_every_series_has_its_boosted_candidate(series):
    found = {r["key"]: r for r in boosted.boosted_candidates(series, KEYS).collect()}
    assert set(found) == set(SERIES)
    for key, (days, values) in SERIES.items():
        row, n, y = found[key], len(values), np.array(values, float)
        assert (row["n"], row["last_y"], row["last_period"]) == (n, values[-1], days[-1])
        if n < 2:
            assert row["score"] is None and row["ahead"] is None
            continue
        months = [d.month for d in days] + [(days[-1].month + i) % 12 + 1 for i in range(3)]
        x = design(range(n + 3), months)
        whole = boosted.boosted_values(x[None], y[None], n)[0]
        assert row["r2"] == pytest.approx(r2(y, whole[:n]))
        assert row["ahead"] == pytest.approx(np.maximum(whole[n:], 0))
        starts, size = boosted.folds_of(n)
        scores = [
            r2(y[s : s + size], boosted.boosted_values(x[None, : s + size], y[None], s)[0][s:]) for s in starts
        ]
        assert row["score"] == pytest.approx(np.mean(scores) if scores else row["r2"])


def test_best_of_three_for_every_series(series):
    linear = {r["key"]: r for r in fc.pick_for(series, KEYS).collect()}
    trees = {r["key"]: r for r in boosted.boosted_candidates(series, KEYS).collect()}
    picked = boosted.pick_of_three(series, KEYS)
    found = {r["key"]: r for r in picked.collect()}
    points = {}
    for r in fc.forecast_points(picked, KEYS).orderBy("key", "step").collect():
        points.setdefault(r["key"], []).append(r["forecast"])
    won = set()
    for key, row in found.items():
        if linear[key]["n"] >= 2 and trees[key]["score"] > linear[key]["score"]:
            won.add(key)
            assert row["model"] == boosted.BOOSTED
            assert points[key] == pytest.approx([round(v, 2) for v in trees[key]["ahead"]], abs=0.006)
        else:
            assert row == linear[key]
    assert 1 < len(won) < len(SERIES)
    assert fc.forecast_summary(picked, KEYS).count() == len(SERIES)


def test_boosted_trees_can_win(spark):
    """Two levels without any trend or season: trees follow the repeated pattern."""
    days = months_from(datetime.date(2020, 1, 1), 48)
    data = [(d, 100.0 if d.month in (3, 4, 8) else 10.0, d.month) for d in days]
    one = spark.createDataFrame(data, "period date, y double, month_num int")
    picked = boosted.pick_of_three(one)
    assert picked.first()["model"] == boosted.BOOSTED
    found = [r["forecast"] for r in fc.forecast_points(picked).orderBy("step").collect()]
    assert found[2] > 50 > max(found[:2])


def test_no_job_while_boosted_forecasts_are_planned(spark, series):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planned", "")
    try:
        boosted.pick_of_three(series, KEYS)
        boosted.boosted_forecast(series, KEYS)
        assert list(tracker.getJobIdsForGroup("planned")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_history(series):
    one = series.where(F.col("key") == "n3").drop("key")
    dated = [r["label"] for r in fc.history(one).orderBy("period").collect()]
    assert dated == ["May 2019", "Jun 2019", "Jul 2019"]
    plain = [r["label"] for r in fc.history(one, calendar=False).orderBy("period").collect()]
    assert plain == ["Period 1", "Period 2", "Period 3"]


def test_monthly_series(sales):
    found = rows(fc.monthly_series(sales).orderBy("period"))
    assert [(str(p), y, m) for p, y, m in found] == [
        ("2016-01-01", 300.5, 1), ("2017-12-01", 300.25, 12),
    ]


def test_month_model_saves_and_predicts(spark, tmp_path):
    frame = spark.createDataFrame(
        [(datetime.date(2024, m, 3), 10.0 + 2 * m) for m in (1, 2, 5, 9)] + [(None, 7.0)],
        "`Order Date` date, Sales double",
    )
    model = fc.month_model(frame)
    assert tuple(model.first()) == pytest.approx((2.0, 10.0, 4))
    fc.save_model(model, str(tmp_path / "model"))
    saved = spark.read.parquet(str(tmp_path / "model"))
    found = spark.range(1).select(fc.apply_month_model(saved, F.lit(12.0))).first()[0]
    assert found == pytest.approx(34.0)


def test_boosted_candidate(series):
    one = series.where(F.col("key") == "n13").drop("key")
    found = boosted.boosted_forecast(one).orderBy("step").collect()
    assert [r["label"] for r in found] == ["Jun 2020", "Jul 2020", "Aug 2020"]
    assert all(r["forecast"] >= 0 and r["r2"] <= 1 for r in found)
    single = boosted.boosted_forecast(one.limit(1)).collect()
    assert [(r["label"], r["forecast"], r["score"]) for r in single] == [("Next Period", one.first()["y"], float("-inf"))]
    assert boosted.boosted_forecast(one.where("false")).count() == 0
    assert boosted.pick_of_three(one.where("false")).first()["model"] == fc.NONE
