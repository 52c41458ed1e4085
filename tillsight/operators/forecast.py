"""Seasonal forecasts of many month series at once.

A series is a set of rows with the same key: ``period`` (a date), ``month_num`` and ``y``.
Its length is bounded by the calendar, not by the number of sales rows, which have been
summed per month before. Everything below works per key:

1. :func:`index_series` numbers the months and centres time and value.
2. :func:`block_moments` cuts each series into the blocks of its cross-validation and sums
   products of time, season and value per block. These sums are all a least-squares fit
   needs, and they add up: the training data of a fold is the sum of the blocks before it.
3. :func:`block_fits` solves ridge and ordinary least squares on every such running sum and
   scores each on the block that follows, or on its own data for the last, complete one.
4. :func:`pick_model` averages the scores and keeps the better candidate's complete fit.
5. :func:`forecast_points` / :func:`forecast_summary` predict.

Steps 1 to 4 partition by the key once and never shuffle again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions import dates
from tillsight.functions.columns import named
from tillsight.functions.numbers import trend_class
from tillsight.operators.breakdowns import or_zero

# Candidates in order of preference, ridge penalty, and the rules for short
# series and display.
RIDGE, LINEAR, FALLBACK, NONE = "ridge_seasonal", "linear_seasonal", "fallback", "none"
PENALTIES = {RIDGE: 8.0, LINEAR: 0.0}
FULL_CV_LENGTH = 8
MOST_FOLDS = 3
HORIZON = 3
SHORT_ACCURACY = 75.0
MOST_ACCURACY = 99.0
NEXT_LABEL = "Next Period"
STEP_LABEL, PAST_LABEL = "Next +", "Period "

# Below this share a determinant counts as zero, i.e. a feature as a mixture of others.
RANK_TOLERANCE = 1e-11
# Below this share of the squared level a sum of squares counts as zero.
FLAT_TOLERANCE = 1e-24

FEATURES = ("t", "s", "c")
_PAIRS = ("tt", "ts", "tc", "ss", "sc", "cc")
_SUMS = ("n", "t", "s", "c", "y", *_PAIRS, "ty", "sy", "cy", "yy")


# Series --------------------------------------------------------------------------------


def monthly_series(
    sales: DataFrame, keys: Sequence[str] = (), day: str = "Order Date", value: str = "Sales"
) -> DataFrame:
    """Sum per key and month. Rows without a date are left out; empty sums are zero."""
    return (
        sales.where(named(day).isNotNull())
        .groupBy(*[named(k) for k in keys], dates.month_start(named(day)).alias("period"))
        .agg(or_zero(F.sum(named(value))).alias("y"))
        .withColumn("month_num", F.month("period"))
    )


def season(month: Column) -> tuple[Column, Column]:
    angle = month * (2 * math.pi) / 12.0
    return F.sin(angle), F.cos(angle)


def features(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Time index and yearly season of every month: (t, sin_m, cos_m)."""
    sin_m, cos_m = season(F.col("month_num"))
    return series_index(series, keys).withColumns({"sin_m": sin_m, "cos_m": cos_m})


def series_index(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Dense index 0, 1, … per key in order of time; missing months leave no gap."""
    in_time = Window.partitionBy(*[named(k) for k in keys]).orderBy("period")
    return series.withColumn("t", F.row_number().over(in_time) - 1)


def index_series(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Index, length and level per key, with time and value taken from their centres."""
    whole = Window.partitionBy(*[named(k) for k in keys])
    return (
        features(series, keys)
        .withColumns({"n": F.count(F.lit(1)).over(whole), "level": F.avg("y").over(whole)})
        .select(
            *[named(k) for k in keys],
            *("period", "month_num", "n", "level", "y"),
            F.col("t").alias("index"),
            (F.col("t") - (F.col("n") - 1) / 2).alias("t"),
            F.col("sin_m").alias("s"),
            F.col("cos_m").alias("c"),
            (F.col("y") - F.col("level")).alias("yc"),
        )
    )


# Moments --------------------------------------------------------------------------------


def folds(n: str) -> tuple[str, str, str]:
    """SQL for the number of folds, the test months per fold, and the months before them."""
    count = f"if({n} < {FULL_CV_LENGTH}, 0L, least({MOST_FOLDS}L, {n} div 4))"
    size = f"({n} div ({count} + 1))"
    return count, size, f"if({n} < {FULL_CV_LENGTH}, {n}, {n} - {count} * {size})"


def block_moments(indexed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sums of products per key and cross-validation block (0 = before the first test)."""
    _, size, first = folds("n")
    block = F.expr(f"cast(if(index < {first}, 0, (index - {first}) div {size} + 1) as int)")
    x = {"t": "t", "s": "s", "c": "c", "y": "yc"}
    sums = ["cast(count(1) as double) as m_n"]
    for name in _SUMS[1:]:
        product = " * ".join(x[letter] for letter in name)
        sums.append(f"sum({product}) as m_{name}")
    return (
        indexed.withColumn("block", block)
        .groupBy(*[named(k) for k in keys], "block")
        .agg(
            F.first("n").alias("length"),
            F.first("level").alias("level"),
            F.max_by("y", "index").alias("last_y"),
            F.max("period").alias("last_period"),
            F.max_by("month_num", "index").alias("last_month"),
            *[F.expr(text) for text in sums],
        )
    )


def _running(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per block: the sums up to it (``r_``) and those of the next block (``v_``)."""
    part = ", ".join("`" + k.replace("`", "``") + "`" for k in keys)
    in_order = f"{'partition by ' + part if keys else ''} order by block"
    so_far = f"{in_order} rows between unbounded preceding and current row"
    return moments.select(
        *[named(k) for k in keys],
        *("block", "length", "level", "last_y", "last_period", "last_month"),
        *[F.expr(f"sum(m_{name}) over ({so_far}) as r_{name}") for name in _SUMS],
        *[F.expr(f"lead(m_{name}) over ({in_order}) as v_{name}") for name in _SUMS],
    )


# Solving --------------------------------------------------------------------------------
#
# The algebra is written as SQL text: one expression each instead of hundreds of columns.

_CENTRED = {
    f"q_{a}{b}": f"r_{a}{b} - r_{a} * r_{b} / r_n"
    for a, b in (*_PAIRS, "ty", "sy", "cy", "yy")
}


def _matrix(name: str, penalty: float) -> dict[str, str]:
    """Penalised normal equations of a candidate: cofactors, trace and determinants."""
    tt, ss, cc = (f"(q_{p} + {penalty}D)" for p in ("tt", "ss", "cc"))
    ts, tc, sc = "q_ts", "q_tc", "q_sc"
    return {
        f"{name}_adj": f"""named_struct(
            'tt', {ss} * {cc} - {sc} * {sc}, 'ts', {tc} * {sc} - {ts} * {cc},
            'tc', {ts} * {sc} - {tc} * {ss}, 'ss', {tt} * {cc} - {tc} * {tc},
            'sc', {ts} * {tc} - {tt} * {sc}, 'cc', {tt} * {ss} - {ts} * {ts})""",
        f"{name}_trace": f"{tt} + {ss} + {cc}",
    }


def _determinants(name: str, penalty: float) -> dict[str, str]:
    adj = f"{name}_adj"
    return {
        f"{name}_second": f"{adj}.tt + {adj}.ss + {adj}.cc",
        f"{name}_third": f"(q_tt + {penalty}D) * {adj}.tt + q_ts * {adj}.ts + q_tc * {adj}.tc",
    }


def _solution(name: str, penalty: float) -> str:
    """Coefficients of the three features as a struct.

    Cramer's rule where the matrix has full rank. Where features are mixtures of each
    other, as with very few months, the solution of least norm is taken; for a symmetric
    matrix it follows from the characteristic polynomial of its non-zero eigenvalues.
    """
    trace, second, third = f"{name}_trace", f"{name}_second", f"{name}_third"
    entries = []
    for f in FEATURES:
        pairs = ["".join(sorted((f, g), key=FEATURES.index)) for g in FEATURES]
        cofactors = " + ".join(f"{name}_adj.{p} * q_{g}y" for p, g in zip(pairs, FEATURES))
        row = " + ".join(f"q_{p} * q_{g}y" for p, g in zip(pairs, FEATURES))
        entries.append(
            f"""'{f}', case
            when {second} > {RANK_TOLERANCE} * {trace} * {trace} then
                if({third} > {RANK_TOLERANCE} * {second} * {trace},
                   ({cofactors}) / {third},
                   (({trace} - {penalty}D) * q_{f}y - ({row})) / {second})
            when {trace} > 0 then q_{f}y / {trace}
            else 0.0D end"""
        )
    return f"named_struct({', '.join(entries)})"


def _r2(prefix: str, name: str) -> str:
    """R² of a candidate on the data whose sums have the given prefix.

    Without any variance it is 1 for an exact fit and 0 otherwise.
    """
    m, w, b = f"{prefix}_", f"w_{name}.", f"b_{name}"
    squares = " + ".join(
        f"{1 if p[0] == p[1] else 2} * {w}{p[0]} * {w}{p[1]} * {m}{p}" for p in _PAIRS
    )
    cross = " + ".join(f"{w}{f} * {m}{f}y" for f in FEATURES)
    along = " + ".join(f"{w}{f} * {m}{f}" for f in FEATURES)
    residual = (
        f"({m}yy - 2 * ({b} * {m}y + {cross}) + {m}n * {b} * {b} + 2 * {b} * ({along}) + {squares})"
    )
    spread = f"({m}yy - {m}y * {m}y / {m}n)"
    nothing = f"{FLAT_TOLERANCE} * {m}n * level * level"
    return f"""case when {spread} > {nothing} then 1 - {residual} / {spread}
        when {residual} <= {nothing} then 1.0D else 0.0D end"""


def _with(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    return frame.withColumns({name: F.expr(text) for name, text in columns.items()})


def block_fits(moments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Fit on the data up to each block, with its score on the next block.

    The last row of a key holds the fit on all its data; its score is the in-sample R².
    """
    fits = _with(_running(moments, keys), _CENTRED)
    for step in (_matrix, _determinants):
        fits = _with(
            fits, {k: v for name, p in PENALTIES.items() for k, v in step(name, p).items()}
        )
    fits = _with(fits, {f"w_{name}": _solution(name, p) for name, p in PENALTIES.items()})
    offsets = {
        f"b_{name}": f"(r_y - {' - '.join(f'w_{name}.{f} * r_{f}' for f in FEATURES)}) / r_n"
        for name in PENALTIES
    }
    fits = _with(fits, {**offsets, "complete": "v_n is null"})
    return _with(
        fits,
        {
            f"r2_{name}": f"if(complete, {_r2('r', name)}, {_r2('v', name)})"
            for name in PENALTIES
        },
    )


def fit_candidates(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per key and candidate: coefficients, in-sample R² and the score models are picked by.

    The score is the mean R² over the expanding-window folds, or the in-sample R² of a
    series too short to be cut.
    """
    fits = block_fits(block_moments(index_series(series, keys), keys), keys)
    aggregates = [
        F.expr(f"max(if(complete, {c}, null)) as {c}")
        for c in ("length", "level", "last_y", "last_period", "last_month")
    ]
    for name in PENALTIES:
        whole = f"named_struct('w', w_{name}, 'b', b_{name}, 'r2', r2_{name})"
        aggregates.append(F.expr(f"max(if(complete, {whole}, null)) as f_{name}"))
        aggregates.append(F.expr(f"avg(if(complete, null, r2_{name})) as cv_{name}"))
    per_key = fits.groupBy(*[named(k) for k in keys]).agg(*aggregates)
    candidates = ", ".join(
        f"""named_struct('candidate_order', {order}, 'model', '{name}',
            'score', coalesce(cv_{name}, f_{name}.r2), 'r2', f_{name}.r2,
            'slope', f_{name}.w.t, 'coef_sin', f_{name}.w.s, 'coef_cos', f_{name}.w.c,
            'intercept', level + f_{name}.b - f_{name}.w.t * (length - 1) / 2)"""
        for order, name in enumerate(PENALTIES)
    )
    return per_key.select(
        *[named(k) for k in keys],
        F.coalesce(F.col("length"), F.lit(0)).alias("n"),
        *("last_y", "last_period", "last_month"),
        F.inline(F.expr(f"array({candidates})")),
    )


def fit_one(series: DataFrame, model: str, keys: Sequence[str] = ()) -> DataFrame:
    """Coefficients of one candidate per key."""
    return (
        fit_candidates(series, keys)
        .where(F.col("model") == model)
        .select(*[named(k) for k in keys], "n", "intercept", "slope", "coef_sin", "coef_cos", "r2")
    )


def cross_validation(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Score of every candidate on every fold of the series that are long enough."""
    fits = block_fits(block_moments(index_series(series, keys), keys), keys)
    scores = F.array(
        *[
            F.struct(F.lit(name).alias("model"), F.col(f"r2_{name}").alias("r2"))
            for name in PENALTIES
        ]
    )
    return fits.where(~F.col("complete")).select(
        *[named(k) for k in keys],
        (F.col("block") + 1).alias("fold"),
        F.col("r_n").cast("bigint").alias("train_months"),
        F.col("v_n").cast("bigint").alias("test_months"),
        F.inline(scores),
    )


def pick_model(candidates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The candidate with the highest score per key; the earliest one wins a tie.

    Series of one month have no model, and an empty unkeyed series none at all. A candidate
    that is no formula brings its predictions as an array, ``ahead``.
    """
    if "ahead" not in candidates.columns:
        candidates = candidates.withColumn("ahead", F.lit(None).cast("array<double>"))
    chosen = F.struct(
        F.coalesce(F.col("score"), F.lit(float("-inf"))).alias("score"),
        (-F.col("candidate_order")).alias("order"),
        *("model", "r2", "intercept", "slope", "coef_sin", "coef_cos", "ahead"),
    )
    best = (
        candidates.groupBy(*[named(k) for k in keys])
        .agg(
            *[F.first(c).alias(c) for c in ("n", "last_y", "last_period", "last_month")],
            F.max(chosen).alias("best"),
        )
    )
    model = (
        F.when(F.col("n") == 0, F.lit(NONE))
        .when(F.col("n") == 1, F.lit(FALLBACK))
        .otherwise(F.col("best.model"))
    )
    return best.select(
        *[named(k) for k in keys],
        F.col("n").cast("bigint").alias("n"),
        *("last_y", "last_period", "last_month"),
        model.alias("model"),
        F.col("best.score").alias("score"),
        F.col("best.r2").alias("r2"),
        *[F.col(f"best.{c}").alias(c) for c in ("intercept", "slope", "coef_sin", "coef_cos", "ahead")],
    )


def history(series: DataFrame, keys: Sequence[str] = (), calendar: bool = True) -> DataFrame:
    """Past months of every series: (period, label, value).

    Without ``calendar`` the labels are "Period 1", "Period 2", …
    """
    if calendar:
        labelled = series.withColumn("label", dates.month_label(F.col("period")))
    else:
        number = (F.col("t") + 1).cast("string")
        labelled = series_index(series, keys).withColumn(
            "label", F.concat(F.lit(PAST_LABEL), number)
        )
    return labelled.select(
        *[named(k) for k in keys], "period", "label", F.round("y", 2).alias("value")
    )


# Prediction -------------------------------------------------------------------------------


def accuracy(r2: Column) -> Column:
    """R² as a percentage between 0 and 99, one decimal."""
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(MOST_ACCURACY), r2 * 100))
    return F.round(F.coalesce(bounded, F.lit(0.0)), 1)


def trend_percent(forecast: Column, last: Column) -> Column:
    return F.when(last > 0, (forecast - last) / last * 100).otherwise(F.lit(0.0))


def future_month(last_month: Column, step: Column) -> Column:
    """Month number ``step`` months on; a number beyond December restarts the year."""
    return (F.when(last_month > 12, step - 1).otherwise(last_month + step - 1) % 12 + 1).cast("int")


def future_label(last_period: Column, step: Column) -> Column:
    return dates.month_label(F.add_months(last_period, step))


def predicted(step: Column, month: Column) -> Column:
    """Prediction of a picked model ``step`` months on, never negative."""
    sin_m, cos_m = season(month)
    index = F.col("n") + step - 1
    value = (
        F.col("intercept")
        + F.col("slope") * index
        + F.col("coef_sin") * sin_m
        + F.col("coef_cos") * cos_m
    )
    return F.greatest(F.lit(0.0), F.coalesce(F.get("ahead", step - 1), value))


def _next_value() -> Column:
    return (
        F.when(F.col("n") == 0, F.lit(0.0))
        .when(F.col("n") == 1, F.col("last_y"))
        .otherwise(predicted(F.lit(1), future_month(F.col("last_month"), F.lit(1))))
    )


def next_values(picked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Next value, accuracy and trend per key, before any rounding for display."""
    value = _next_value()
    trend = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(trend_percent(value, F.col("last_y")))
    return picked.select(
        *[named(k) for k in keys],
        "n",
        "model",
        value.alias("forecast_value"),
        F.when(F.col("n") == 0, F.lit(0.0))
        .when(F.col("n") == 1, F.lit(SHORT_ACCURACY))
        .otherwise(accuracy(F.col("r2")))
        .alias("forecast_accuracy"),
        trend.alias("forecast_trend"),
        trend_class(trend).alias("trend_class"),
    )


def forecast_summary(picked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Next value, accuracy and trend per key, rounded for display."""
    return next_values(picked, keys).withColumns(
        {
            "forecast_value": F.round("forecast_value", 2),
            "forecast_trend": F.round("forecast_trend", 1),
        }
    )


def forecast_points(
    picked: DataFrame,
    keys: Sequence[str] = (),
    horizon: int = HORIZON,
    calendar: bool = True,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per key and future month: (step, label, month_num, forecast).

    A series of one month repeats its value once, under the label "Next Period". Without
    ``calendar`` the labels are "Next +1", "Next +2", …
    """
    steps = F.when(F.col("n") == 1, F.array(F.lit(1))).when(
        F.col("n") > 1, F.sequence(F.lit(1), F.lit(horizon))
    )
    step = F.col("step")
    label = future_label(F.col("last_period"), step) if calendar else F.concat(F.lit(STEP_LABEL), step)
    return (
        picked.withColumn("step", F.explode(steps))
        .withColumn("month_num", future_month(F.col("last_month"), step))
        .select(
            *[named(k) for k in keys],
            "step",
            F.when(F.col("n") == 1, F.lit(NEXT_LABEL)).otherwise(label).alias("label"),
            "month_num",
            F.round(
                F.when(F.col("n") == 1, F.col("last_y")).otherwise(
                    predicted(step, F.col("month_num"))
                ),
                2,
            ).alias("forecast"),
            *carry,
        )
    )


def pick_for(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return pick_model(fit_candidates(series, keys), keys)


def forecast(series: DataFrame, keys: Sequence[str] = (), horizon: int = HORIZON) -> DataFrame:
    """Future months of every series."""
    return forecast_points(pick_for(series, keys), keys, horizon)


# Other models -------------------------------------------------------------------------------


def month_model(sales: DataFrame) -> DataFrame:
    """Straight line of sales over the month number on the order lines, in one aggregate."""
    month, value = F.month(named("Order Date")).cast("double"), named("Sales")
    return sales.agg(
        F.regr_slope(value, month).alias("slope"),
        F.regr_intercept(value, month).alias("intercept"),
        F.regr_count(value, month).alias("rows"),
    )


def save_model(coefficients: DataFrame, path: str) -> None:
    coefficients.write.mode("overwrite").parquet(path)


def apply_month_model(model: DataFrame, month: Column) -> Column:
    """Prediction for a month number from a saved model of one row."""
    slope, intercept = (model.select(c).scalar() for c in ("slope", "intercept"))
    return intercept + slope * month
