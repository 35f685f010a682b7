"""K01 to K09: forecasters over many series."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidecast.functions.calendar import harmonics
from tidecast.models import arima, forecast
from tidecast.operators.windows import series
from tidecast.queries.registry import F2, F5, event_days, query, r, rounded, weekly

EVENT = ["event_type"]
PANEL = ["r_name", "c_mktsegment"]


@query(
    "k01_naive",
    f"""SELECT r_name, c_mktsegment, step, round(arg_max(y, wk), 2) + 0.0 AS y_pred FROM {F2} x, (SELECT unnest(generate_series(1, 10)) AS step) s GROUP BY 1, 2, 3""",
)
def naive(spark, sf):
    return rounded(forecast.last_value_forecast(weekly(spark, sf), PANEL, "wk", "y", 10), 2)


@query(
    "k02_seasonal_naive",
    f"""SELECT r_name, c_mktsegment, step, round(y, 2) + 0.0 AS y_pred FROM
        (SELECT *, row_number() OVER (PARTITION BY r_name, c_mktsegment ORDER BY wk DESC) AS back FROM {F2} x) t
        JOIN (SELECT unnest(generate_series(1, 10)) AS step) s ON back = 4 - (step - 1) % 4""",
)
def seasonal_naive(spark, sf):
    return rounded(forecast.seasonal_forecast(weekly(spark, sf), PANEL, "wk", "y", 4, 10), 2)


ALPHAS = [round(0.05 * i, 2) for i in range(1, 20)]


@query(
    "k03_simple_smoothing",
    f"""WITH RECURSIVE s AS (SELECT event_type, y, row_number() OVER (PARTITION BY event_type ORDER BY t) AS i FROM {F5} x),
        a AS (SELECT cast(i * 0.05 AS decimal(4,2))::DOUBLE AS alpha FROM (SELECT unnest(generate_series(1, 19)) AS i) g),
        f AS (SELECT event_type, alpha, cast(1 AS bigint) AS i, y AS level, 0.0::DOUBLE AS sse FROM s, a WHERE i = 1
          UNION ALL SELECT f.event_type, f.alpha, s.i, f.alpha * s.y + (1 - f.alpha) * f.level, f.sse + (s.y - f.level) * (s.y - f.level)
          FROM f JOIN s ON s.event_type = f.event_type AND s.i = f.i + 1),
        e AS (SELECT event_type, alpha, arg_max(level, i) AS level, arg_max(sse, i) AS sse FROM f GROUP BY 1, 2)
        SELECT event_type, arg_min(alpha, sse) AS alpha, round(min(sse), 2) + 0.0 AS sse, round(arg_min(level, sse), 4) + 0.0 AS level FROM e GROUP BY 1""",
)
def simple_smoothing(spark, sf):
    arrays = forecast.series_arrays(event_days(spark, sf), EVENT, "t", "y")
    grid = forecast.smoothing_grid(None, None, False, 1, alphas=ALPHAS)
    best = forecast.pick_best(forecast.smooth(arrays, EVENT, grid), EVENT, "sse")
    return best.select("event_type", "alpha", r("sse", 2).alias("sse"), r("level", 4).alias("level"))


@query(
    "k03_searched_weights",
    f"""WITH RECURSIVE s AS (SELECT event_type, y, row_number() OVER (PARTITION BY event_type ORDER BY t) AS i FROM {F5} x),
        a AS (SELECT i / 4000.0::DOUBLE AS alpha FROM (SELECT unnest(generate_series(0, 4000)) AS i) g),
        f AS (SELECT event_type, alpha, cast(1 AS bigint) AS i, y AS level, 0.0::DOUBLE AS sse FROM s, a WHERE i = 1
          UNION ALL SELECT f.event_type, f.alpha, s.i, f.alpha * s.y + (1 - f.alpha) * f.level, f.sse + (s.y - f.level) * (s.y - f.level)
          FROM f JOIN s ON s.event_type = f.event_type AND s.i = f.i + 1),
        e AS (SELECT event_type, alpha, max(i) - 1 AS n, arg_max(sse, i) AS sse FROM f GROUP BY 1, 2)
        SELECT event_type, round(sqrt(min(sse / n)), 1) + 0.0 AS rmse FROM e GROUP BY 1""",
)
def searched_weights(spark, sf):
    """The error that the searched weight reaches; the SQL tries every weight of a fine grid."""
    arrays = forecast.series_arrays(event_days(spark, sf), EVENT, "t", "y")
    best = forecast.smooth(arrays, EVENT, forecast.smoothing_grid(None, None, False, 1), search=True)
    return best.select("event_type", r(F.sqrt(F.col("sse") / (F.col("n") - 1)), 1).alias("rmse"))


@query("k03_smoothing_variants")
def smoothing_variants(spark, sf):
    arrays = forecast.series_arrays(event_days(spark, sf), EVENT, "t", "y")
    grid = [
        *forecast.smoothing_grid("mul", None, True, 7),
        *forecast.smoothing_grid("add", "mul", False, 7),
        *forecast.smoothing_grid("add", "add", True, 7),
    ]
    best = forecast.pick_best(forecast.smooth(arrays, EVENT, grid, search=True), EVENT)
    return rounded(forecast.smoothing_forecast(best, EVENT, 14), 4)


@query("k04_smoothing_auto")
def smoothing_auto(spark, sf):
    return rounded(forecast.smoothing_auto(event_days(spark, sf), EVENT, "t", "y", 7, 14), 4)


@query("k05_difference_order")
def difference_order(spark, sf):
    return arima.difference_orders(weekly(spark, sf), PANEL, "wk", "y")


def event_split(spark, sf):
    """Event series with positions, harmonics and the last six days of each as the horizon."""
    pos = (F.row_number().over(series(EVENT, "t")) - 1).alias("pos")
    n = F.count("*").over(W.partitionBy(*EVENT)).alias("n")
    df = event_days(spark, sf).select(*EVENT, pos, "y", n)
    df = df.withColumns(harmonics(F.col("pos"), 7))
    return df.where("pos < n - 6"), df.where("pos >= n - 6"), ["x_t", "x_sin", "x_cos"]


@query("k06_arimax")
def arimax(spark, sf):
    train, future, exog = event_split(spark, sf)
    fits = arima.fit_orders(train, future, EVENT, "pos", "y", [(1, 1, 1, 0, 0, 0, 1)], 6, exog)
    return rounded(arima.order_forecast(fits, EVENT), 4)


@query("k07_order_search")
def order_search(spark, sf):
    df = weekly(spark, sf)
    d = arima.difference_orders(df, PANEL, "wk", "y")
    fits = arima.fit_orders(df, None, PANEL, "wk", "y", arima.search_grid(), 10, d=d)
    return rounded(arima.best_order(fits, PANEL).select(*PANEL, "p", "d", "q", "aic", "status"), 4)


@query("k08_sarimax")
def sarimax(spark, sf):
    fits = arima.fit_orders(weekly(spark, sf), None, PANEL, "wk", "y", [(1, 1, 1, 1, 1, 1, 4)], 10, step=1)
    return rounded(arima.order_forecast(fits, PANEL), 4)


@query("k09_seasonal_order_search")
def seasonal_order_search(spark, sf):
    fits = arima.fit_orders(weekly(spark, sf), None, PANEL, "wk", "y", arima.seasonal_grid(4), 10, step=1)
    return rounded(arima.best_order(fits, PANEL).select(*PANEL, "p", "d", "q", "sp", "sd", "sq", "s", "aic", "status"), 4)
