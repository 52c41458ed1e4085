"""The forecast in plain SQL, written the long way round.

It fits on explicit folds with centred covariances and scores by the residual of every
single month, where the library adds up moments per block. The solution of folds without
full rank is the library's own; ``tests/test_forecast.py`` checks that one with numpy.
"""

from __future__ import annotations

_SOLVE = """
  CASE WHEN sec > 1e-11 * tr * tr AND det > 1e-11 * sec * tr THEN ({adjoint}) / det
       WHEN sec > 1e-11 * tr * tr THEN (tr * {right} - ({row})) / sec
       WHEN tr > 0 THEN {right} / tr ELSE 0.0 END"""

_W = {
    "wt": _SOLVE.format(
        adjoint="(ss*cc - sc*sc)*ty + (tc*sc - ts*cc)*sy + (ts*sc - tc*ss)*cy",
        right="ty",
        row="tt*ty + ts*sy + tc*cy",
    ),
    "ws": _SOLVE.format(
        adjoint="(tc*sc - ts*cc)*ty + (tt*cc - tc*tc)*sy + (ts*tc - tt*sc)*cy",
        right="sy",
        row="ts*ty + ss*sy + sc*cy",
    ),
    "wc": _SOLVE.format(
        adjoint="(ts*sc - tc*ss)*ty + (ts*tc - tt*sc)*sy + (tt*ss - ts*ts)*cy",
        right="cy",
        row="tc*ty + sc*sy + cc*cy",
    ),
}


def forecast_ctes(series: str, keys: list[str]) -> str:
    """CTEs from ``series`` (keys, period, month_num, y) to ``picked``; keys may be empty."""
    k = "".join(f'"{key}", ' for key in keys)
    ka = "".join(f'a."{key}", ' for key in keys)
    part = f"PARTITION BY {k.rstrip(', ')}" if keys else ""
    both = "".join(f'a."{key}" IS NOT DISTINCT FROM b."{key}" AND ' for key in keys)
    group = k.rstrip(", ")
    by_fold = f"{k}n, fold, first, size"
    return f"""
series AS ({series}),
idx AS (
  SELECT {k}period, month_num, y, row_number() OVER ({part} ORDER BY period) - 1 AS t,
         count(*) OVER ({part}) AS n,
         sin(month_num * 2 * pi() / 12.0) AS s, cos(month_num * 2 * pi() / 12.0) AS c
  FROM series
),
sized AS (SELECT *, CASE WHEN n < 8 THEN 0 ELSE least(3, n // 4) END AS folds FROM idx),
fold_rows AS (
  SELECT *, CASE WHEN fold = 0 THEN n ELSE n - (folds - fold + 1) * (n // (folds + 1)) END AS first,
         CASE WHEN fold = 0 THEN n ELSE n // (folds + 1) END AS size
  FROM (SELECT *, unnest(range(0, folds + 1)) AS fold FROM sized)
),
moments AS (
  SELECT {by_fold}, avg(t) AS mt, avg(s) AS ms, avg(c) AS mc, avg(y) AS my,
         covar_pop(t,t)*count(*) AS tt0, covar_pop(t,s)*count(*) AS ts, covar_pop(t,c)*count(*) AS tc,
         covar_pop(s,s)*count(*) AS ss0, covar_pop(s,c)*count(*) AS sc, covar_pop(c,c)*count(*) AS cc0,
         covar_pop(t,y)*count(*) AS ty, covar_pop(s,y)*count(*) AS sy, covar_pop(c,y)*count(*) AS cy
  FROM fold_rows WHERE t < first GROUP BY ALL
),
penal AS (
  SELECT *, tt0 + alpha AS tt, ss0 + alpha AS ss, cc0 + alpha AS cc
  FROM moments CROSS JOIN
    (VALUES (0, 'ridge_seasonal', 8.0), (1, 'linear_seasonal', 0.0)) AS v(ord, model, alpha)
),
dets AS (
  SELECT *, tt + ss + cc AS tr, (ss*cc - sc*sc) + (tt*cc - tc*tc) + (tt*ss - ts*ts) AS sec,
         tt*(ss*cc - sc*sc) + ts*(tc*sc - ts*cc) + tc*(ts*sc - tc*ss) AS det
  FROM penal
),
solved AS (
  SELECT *, {_W['wt']} AS wt, {_W['ws']} AS ws, {_W['wc']} AS wc FROM dets
),
fits AS (SELECT *, my - wt*mt - ws*ms - wc*mc AS b FROM solved),
tested AS (
  SELECT {ka}a.n, a.fold, b.ord, b.model, a.y, b.b + b.wt*a.t + b.ws*a.s + b.wc*a.c AS p
  FROM fold_rows a JOIN fits b ON {both}a.fold = b.fold
  WHERE (a.fold = 0) OR (a.t >= a.first AND a.t < a.first + a.size)
),
scored AS (
  SELECT {k}fold, ord, model,
         CASE WHEN var_pop(y) > 1e-20 * avg(y) * avg(y)
              THEN 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))
              WHEN sum((y - p) * (y - p)) <= 1e-20 * count(*) * avg(y) * avg(y) THEN 1.0
              ELSE 0.0 END AS r2
  FROM tested GROUP BY ALL
),
picks AS (
  SELECT {k}ord, model,
         coalesce(avg(r2) FILTER (WHERE fold > 0), max(r2) FILTER (WHERE fold = 0)) AS score,
         max(r2) FILTER (WHERE fold = 0) AS r2
  FROM scored GROUP BY ALL
),
candidates AS (
  SELECT {ka}a.ord, a.model, a.score, a.r2, b.n, b.wt AS slope, b.ws AS coef_sin, b.wc AS coef_cos,
         b.b AS intercept
  FROM picks a JOIN fits b ON {both}a.ord = b.ord AND b.fold = 0
),
ends AS (
  SELECT {k}max(period) AS last_period, arg_max(month_num, period) AS last_month,
         arg_max(y, period) AS last_y
  FROM series {'GROUP BY ' + group if keys else ''}
),
picked AS (
  SELECT a.*, b.last_period, b.last_month, b.last_y
  FROM (SELECT *, row_number() OVER ({part} ORDER BY score DESC, ord) AS place FROM candidates) a
  JOIN ends b ON {both}true
  WHERE place = 1
),
steps AS (
  SELECT *, ((last_month + step - 1) % 12) + 1 AS future_month
  FROM (SELECT *, unnest(range(1, 4)) AS step FROM picked)
),
points AS (
  SELECT *, greatest(0, intercept + slope * (n - 1 + step)
         + coef_sin * sin(future_month * 2 * pi() / 12.0)
         + coef_cos * cos(future_month * 2 * pi() / 12.0)) AS forecast
  FROM steps
)
"""


def points_select(keys: list[str]) -> str:
    k = "".join(f'"{key}", ' for key in keys)
    return f"""
SELECT {k}CAST(step AS INTEGER) AS step,
       CASE WHEN n = 1 THEN 'Next Period'
            ELSE strftime(last_period + to_months(CAST(step AS INTEGER)), '%b %Y') END AS label,
       CAST(future_month AS INTEGER) AS month_num,
       round(CASE WHEN n = 1 THEN last_y ELSE forecast END, 2) AS forecast
FROM points WHERE n > 1 OR step = 1
"""


NEXTS = """
nexts AS (SELECT *, CASE WHEN n = 1 THEN last_y ELSE forecast END AS value,
                 CASE WHEN n > 1 AND last_y > 0 THEN (forecast - last_y) / last_y * 100
                      ELSE 0.0 END AS trend,
                 CASE WHEN n = 1 THEN 75.0
                      ELSE round(greatest(0.0, least(99.0, r2 * 100)), 1) END AS accuracy
          FROM points WHERE step = 1)
"""


def summary_select(keys: list[str]) -> str:
    k = "".join(f'"{key}", ' for key in keys)
    return f"""
, {NEXTS}
SELECT {k}n, CASE WHEN n = 1 THEN 'fallback' ELSE model END AS model,
       round(value, 2) AS forecast_value, accuracy AS forecast_accuracy, round(trend, 1) AS forecast_trend,
       CASE WHEN trend >= 0 THEN 'up' ELSE 'down' END AS trend_class
FROM nexts
"""


def boosted_ctes(keys: list[str]) -> str:
    """CTEs after those of :func:`forecast_ctes`, which must be recursive: ``boosted``.

    A step of the recursion is one level of all trees, or their leaves: every month is ranked by
    each feature within its node, sums over the ranks give the gain of each split, and the best
    split of a node sends its months on.
    """
    k = "".join(f'"{key}", ' for key in keys)
    g = "concat_ws('|', " + "".join(f"coalesce(CAST(\"{key}\" AS VARCHAR), '?'), " for key in keys) + "fold)"
    both = "".join(f'a."{key}" IS NOT DISTINCT FROM b."{key}" AND ' for key in keys)
    ka = "".join(f'a."{key}", ' for key in keys)
    best = "".join(
        f", max(CASE WHEN f = {f} THEN best END) OVER node AS g{f}"
        f", max(CASE WHEN f = {f} THEN cut END) OVER node AS c{f}"
        for f in range(3)
    )
    return f"""
, pts AS (
  SELECT {k}{g} AS g, fold, size, n, t, first AS m, y, CAST(t AS DOUBLE) AS x0, s AS x1, c AS x2
  FROM fold_rows WHERE n > 1
  UNION ALL
  SELECT {k}{g}, fold, n, n, n - 1 + step, n, NULL, n - 1 + step,
         sin(future_month * 2 * pi() / 12.0), cos(future_month * 2 * pi() / 12.0)
  FROM (SELECT *, 0 AS fold FROM steps) WHERE n > 1
),
grow AS (
  SELECT 0 AS step, g, t, m, y, x0, x1, x2, 0 AS node, avg(y) FILTER (t < m) OVER (PARTITION BY g) AS p,
         1e-24 * sum(y * y) FILTER (t < m) OVER (PARTITION BY g) AS least
  FROM pts
  UNION ALL
  SELECT step + 1, g, t, m, y, x0, x1, x2,
         CASE WHEN step % 4 = 3 THEN 0
              WHEN g2 > b1 + 1e-9 * abs(b1) THEN 2 * node + CAST(x2 > c2 AS INTEGER)
              WHEN g1 > b0 + 1e-9 * abs(b0) THEN 2 * node + CAST(x1 > c1 AS INTEGER)
              WHEN g0 > least + 1e-9 * abs(least) THEN 2 * node + CAST(x0 > c0 AS INTEGER)
              ELSE 2 * node END,
         CASE WHEN step % 4 = 3 THEN p + 0.08::DOUBLE * leaf ELSE p END, least
  FROM (
    SELECT *, CASE WHEN g1 > b0 + 1e-9 * abs(b0) THEN g1 ELSE b0 END AS b1
    FROM (
      SELECT *, CASE WHEN g0 > least + 1e-9 * abs(least) THEN g0 ELSE least END AS b0
      FROM (
        SELECT *{best}
        FROM (
          SELECT *, min(CASE WHEN gain = best THEN (v + later) / 2 END) OVER (PARTITION BY g, node, f) AS cut
          FROM (
            SELECT *, max(gain) OVER (PARTITION BY g, node, f) AS best
            FROM (
              SELECT *, CASE WHEN seen AND later > v + 1e-7 THEN
                          ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) - ts * ts / tn END AS gain
              FROM (
                SELECT *, count(*) FILTER (seen) OVER upto AS ln, sum(rest) FILTER (seen) OVER upto AS ls,
                       count(*) FILTER (seen) OVER every AS tn, sum(rest) FILTER (seen) OVER every AS ts,
                       coalesce(avg(rest) FILTER (seen) OVER every, 0) AS leaf,
                       min(v) FILTER (seen) OVER onward AS later
                FROM (
                  SELECT *, unnest([0, 1, 2]) AS f, unnest([x0, x1, x2]) AS v
                  FROM (
                    SELECT *, y - p AS rest, t < m AND rank() OVER (
                             PARTITION BY g ORDER BY t >= m, (t + 1) * ((42 * 7919 + (step // 4 + 1) * 104729) % 1000003)
                                                     % 1000003) <= greatest(1, floor(0.9::DOUBLE * m)) AS seen
                    FROM grow WHERE step < 140))
                WINDOW upto AS (PARTITION BY g, node, f ORDER BY v, t ROWS UNBOUNDED PRECEDING),
                       every AS (PARTITION BY g, node, f),
                       onward AS (PARTITION BY g, node, f ORDER BY v, t
                                  ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)))))
        WINDOW node AS (PARTITION BY g, node)))) WHERE f = 0
),
grown AS (
  SELECT a.*, b.p FROM pts a JOIN grow b ON a.g = b.g AND a.t = b.t AND b.step = 140
),
boosted_fits AS (
  SELECT {k}fold, CASE WHEN var_pop(y) > 1e-20 * avg(y) * avg(y)
              THEN 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))
              WHEN sum((y - p) * (y - p)) <= 1e-20 * count(*) * avg(y) * avg(y) THEN 1.0
              ELSE 0.0 END AS r2
  FROM grown WHERE t < n AND (fold = 0 OR t >= m AND t < m + size) GROUP BY ALL
),
boosted_scores AS (
  SELECT {k}coalesce(avg(r2) FILTER (fold > 0), max(r2) FILTER (fold = 0)) AS score,
         max(r2) FILTER (fold = 0) AS r2
  FROM boosted_fits {'GROUP BY ALL' if keys else ''}
),
boosted AS (
  SELECT {ka}a.step, a.future_month, a.n, a.last_period, a.last_y, b.score, b.r2, c.p AS forecast,
         a.model AS linear, a.score AS linear_score, a.r2 AS linear_r2, l.forecast AS linear_forecast
  FROM steps a JOIN boosted_scores b ON {both}true
  JOIN points l ON {both.replace('b.', 'l.')}a.step = l.step
  JOIN grown c ON {both.replace('b.', 'c.')}c.fold = 0 AND c.t = a.n - 1 + a.step
),
three AS (
  SELECT {k}step, future_month, n, last_period, last_y,
         CASE WHEN score > linear_score THEN 'gbr_seasonal' ELSE linear END AS model,
         greatest(score, linear_score) AS score,
         CASE WHEN score > linear_score THEN r2 ELSE linear_r2 END AS r2,
         CASE WHEN score > linear_score THEN greatest(0, forecast) ELSE linear_forecast END AS forecast
  FROM boosted
)
"""
