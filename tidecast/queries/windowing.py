"""F: window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.operators import windows as win
from tidecast.queries.registry import (
    F1,
    F2,
    F4,
    F5,
    PREDICTIONS,
    RESULTS,
    daily,
    event_days,
    monthly,
    predictions,
    query,
    r,
    results,
    rounded,
    weekly,
)

PANEL = ["r_name", "c_mktsegment"]
PANEL_SQL = "PARTITION BY r_name, c_mktsegment ORDER BY wk"


@query(
    "f01_series_lags",
    f"""SELECT cast(t AS varchar) AS t, lag(y, 1) OVER (ORDER BY t) AS lag_1, lag(y, 7) OVER (ORDER BY t) AS lag_7,
        lag(y, 14) OVER (ORDER BY t) AS lag_14 FROM {F1} x""",
)
def series_lags(spark, sf):
    w = win.series(["series_id"], "t")
    df = daily(spark, sf).withColumns(win.lag_columns("y", [1, 7, 14], w))
    return rounded(df.select("t", "lag_1", "lag_7", "lag_14"), 2)


@query(
    "f02_panel_lags",
    f"""SELECT r_name, c_mktsegment, wk, lag(y, 1) OVER w AS lag_1, lag(y, 4) OVER w AS lag_4, lag(y, 8) OVER w AS lag_8
        FROM {F2} x WINDOW w AS ({PANEL_SQL})""",
)
def panel_lags(spark, sf):
    w = win.series(PANEL, "wk")
    return weekly(spark, sf).select(*PANEL, "wk", *[c.alias(n) for n, c in win.lag_columns("y", [1, 4, 8], w).items()])


@query(
    "f03_rolling_mean",
    f"""SELECT r_name, c_mktsegment, wk, round(avg(y) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 4) + 0.0 AS rolling_mean_4
        FROM {F2} x WINDOW w AS ({PANEL_SQL})""",
)
def rolling_mean(spark, sf):
    cols = win.rolling_columns("y", [4], win.series(PANEL, "wk"))
    return rounded(weekly(spark, sf).select(*PANEL, "wk", cols["rolling_mean_4"].alias("rolling_mean_4")), 4)


@query(
    "f04_rolling_std",
    f"""SELECT s_nationkey, p_type, cast(t AS varchar) AS t,
        round(stddev_samp(y) OVER (PARTITION BY s_nationkey, p_type ORDER BY t ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 4) + 0.0 AS rolling_std_7
        FROM {F4} x""",
)
def rolling_std(spark, sf):
    keys = ["s_nationkey", "p_type"]
    cols = win.rolling_columns("y", [7], win.series(keys, "t"))
    return rounded(monthly(spark, sf).select(*keys, "t", cols["rolling_std_7"].alias("rolling_std_7")), 4)


@query(
    "f05_price_change",
    f"""SELECT r_name, c_mktsegment, wk, round(d, 4) + 0.0 AS price_change, CASE WHEN d > 0 THEN 1 ELSE 0 END AS price_change_yn,
        round(coalesce(d / nullif(p, 0), 0), 6) + 0.0 AS price_change_pct FROM
        (SELECT *, checkout_price - lag(checkout_price) OVER ({PANEL_SQL}) AS d, lag(checkout_price) OVER ({PANEL_SQL}) AS p FROM {F2} x) z""",
)
def price_change(spark, sf):
    c = win.change_columns("checkout_price", win.series(PANEL, "wk"))
    return weekly(spark, sf).select(
        *PANEL,
        "wk",
        r(c["price_change"], 4).alias("price_change"),
        c["price_change_yn"].alias("price_change_yn"),
        r(c["price_change_pct"]).alias("price_change_pct"),
    )


@query(
    "f06_time_index",
    f"""SELECT cast(t AS varchar) AS t, cast(date_diff('day', (SELECT min(t) FROM {F1} m), t) AS int) AS time_index FROM {F1} x""",
)
def time_index(spark, sf):
    return rounded(win.time_index(daily(spark, sf), "t").select("t", "time_index"))


@query(
    "f07_model_rank",
    f"SELECT case_id, model, cast(rank() OVER (PARTITION BY case_id ORDER BY rmse) AS int) AS rank FROM {RESULTS} x",
)
def model_rank(spark, sf):
    return win.rank_models(results(spark, sf), "rmse").select("case_id", "model", "rank")


@query(
    "f08_average_rank",
    f"""SELECT model, round(avg(rk), 6) + 0.0 AS mean_rank FROM
        (SELECT model, rank() OVER (PARTITION BY case_id ORDER BY rmse) AS rk FROM {RESULTS} x) z GROUP BY 1""",
)
def average_rank(spark, sf):
    return rounded(win.average_rank(results(spark, sf), "rmse"))


def _decompose_sql(source: str, keys: list[str], t: str, period: int) -> str:
    half, by = period // 2, ", ".join(keys)
    around = f"w ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING"
    if period % 2:
        trend = f"sum(y) OVER ({around}) / {period}"
    else:
        trend = f"(sum(y) OVER ({around}) - 0.5 * (lag(y, {half}) OVER w + lead(y, {half}) OVER w)) / {period}"
    return f"""WITH b AS (SELECT *, row_number() OVER w - 1 AS pos,
      CASE WHEN count(y) OVER ({around}) = {2 * half + 1} THEN {trend} END AS trend
      FROM {source} s WINDOW w AS (PARTITION BY {by} ORDER BY {t})),
      c AS (SELECT {by}, pos % {period} AS phase, avg(y - trend) AS raw FROM b GROUP BY ALL),
      d AS (SELECT {by}, avg(raw) AS lev FROM c GROUP BY ALL)
      SELECT {", ".join("b." + k for k in keys)}, cast({t} AS varchar) AS t, round(y, 3) + 0.0 AS y, round(trend, 3) + 0.0 AS trend,
      round(raw - lev, 3) + 0.0 AS seasonal, round(y - trend - (raw - lev), 3) + 0.0 AS residual
      FROM b JOIN c ON c.phase = b.pos % {period} AND {" AND ".join(f"b.{k} = c.{k}" for k in keys)}
      JOIN d ON {" AND ".join(f"b.{k} = d.{k}" for k in keys)}"""


@query(
    "f09_decompose_odd",
    _decompose_sql(F5, ["event_type"], "t", 7),
)
def decompose_odd(spark, sf):
    return rounded(win.decompose(event_days(spark, sf), "y", ["event_type"], "t", 7), 3)


@query(
    "f09_decompose_even",
    _decompose_sql(F2, PANEL, "wk", 4),
)
def decompose_even(spark, sf):
    out = win.decompose(weekly(spark, sf), "y", PANEL, "wk", 4)
    return rounded(out.select(*PANEL, F.col("wk").cast("string").alias("t"), "y", "trend", "seasonal", "residual"), 3)


@query(
    "f10_difference",
    f"""SELECT r_name, c_mktsegment, wk, round(y - 2 * lag(y, 1) OVER w + lag(y, 2) OVER w, 3) + 0.0 AS second,
        round(y - lag(y, 1) OVER w - lag(y, 4) OVER w + lag(y, 5) OVER w, 3) + 0.0 AS seasonal FROM {F2} x WINDOW w AS ({PANEL_SQL})""",
)
def difference(spark, sf):
    df = weekly(spark, sf)
    second = win.difference(df, "y", PANEL, "wk", 2).withColumnRenamed("diff", "second")
    both = win.difference(second, "y", PANEL, "wk", 1, season=4).withColumnRenamed("diff", "seasonal")
    return rounded(both.select(*PANEL, "wk", "second", "seasonal"), 3)


@query(
    "f11_residuals",
    f"""SELECT 'naive in sample' AS kind, 'all' AS series_id, cast(row_number() OVER (ORDER BY t) AS int) AS step,
        round(y - lag(y) OVER (ORDER BY t), 2) + 0.0 AS residual FROM {F1} x
        UNION ALL SELECT case_id || ' ' || model, series_id, step, round(y_true - y_pred, 2) + 0.0 FROM {PREDICTIONS} p""",
)
def residuals(spark, sf):
    w = win.series(["series_id"], "t")
    inside = win.naive_residuals(daily(spark, sf), "y", ["series_id"], "t").select(
        F.lit("naive in sample").alias("kind"), "series_id", F.row_number().over(w).alias("step"), "residual"
    )
    test = predictions(spark, sf).select(
        F.concat_ws(" ", "case_id", "model").alias("kind"),
        "series_id",
        "step",
        (F.col("y_true") - F.col("y_pred")).alias("residual"),
    )
    return rounded(inside.unionByName(test), 2)
