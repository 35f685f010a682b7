"""J: evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.functions import metrics
from tidecast.models import regress
from tidecast.operators import aggregate as agg
from tidecast.operators import evaluate as ev
from tidecast.operators.split import temporal_split
from tidecast.queries.projections import LINES
from tidecast.queries.registry import (
    F2,
    F3,
    F4,
    PREDICTIONS,
    RESULTS,
    lines,
    monthly,
    predictions,
    query,
    results,
    rounded,
    weekly,
)
from tidecast.session import materialise
from tidecast.queries.scans import LINE, daily_line

def _one(name, metric, sql, digits=3):
    @query(name, f"SELECT case_id, model, round({sql}, {digits}) + 0.0 AS value FROM {PREDICTIONS} p GROUP BY 1, 2")
    def run(spark, sf):
        return rounded(predictions(spark, sf).groupBy("case_id", "model").agg(metric(F.col("y_true"), F.col("y_pred")).alias("value")), digits)

    return run


E2 = "(y_true - y_pred) * (y_true - y_pred)"
mae = _one("j01_mae", metrics.mae, "avg(abs(y_true - y_pred))")
rmse = _one("j02_rmse", metrics.rmse, f"sqrt(avg({E2}))")
mape = _one("j03_mape", metrics.mape, "100 * avg(CASE WHEN abs(y_true) > 1e-10 THEN abs((y_true - y_pred) / y_true) END)", 4)
r2 = _one("j04_r2", metrics.r2, f"1 - sum({E2}) / nullif(var_pop(y_true) * count(*), 0)", 5)
rmsle = _one("j05_rmsle", metrics.rmsle, "sqrt(avg(pow(ln(1 + greatest(y_true, 0)) - ln(1 + greatest(y_pred, 0)), 2)))", 5)


@query(
    "j06_all_metrics",
    f"""SELECT case_id, model, split, round(mae, 3) + 0.0 AS mae, round(rmse, 3) + 0.0 AS rmse, round(mape, 3) + 0.0 AS mape, round(r2, 3) + 0.0 AS r2,
        round(rmsle, 3) + 0.0 AS rmsle, n FROM {RESULTS} x""",
)
def all_metrics(spark, sf):
    return rounded(results(spark, sf), 3)


@query(
    "j07_compare_models",
    f"SELECT model, round(mae, 3) + 0.0 AS mae, round(rmse, 3) + 0.0 AS rmse FROM {RESULTS} x WHERE case_id = 'case1' AND split = 'test' ORDER BY rmse",
)
def compare(spark, sf):
    return rounded(ev.compare_models(results(spark, sf), "case1").select("model", "mae", "rmse"), 3)


@query(
    "j08_relative_mae",
    f"SELECT x.case_id, x.model, round(x.mae / b.mae, 6) + 0.0 AS rmae FROM {RESULTS} x JOIN {RESULTS} b ON x.case_id = b.case_id AND b.model = 'Naive'",
)
def relative_mae(spark, sf):
    return rounded(ev.relative_mae(results(spark, sf)).select("case_id", "model", "rmae"))


@query(
    "j09_error_distribution",
    f"""SELECT case_id, model, round(quantile_cont(y_true - y_pred, 0.5), 2) + 0.0 AS median_error, round(quantile_cont(abs(y_true - y_pred), 0.5), 2) + 0.0 AS median_abs_error,
        round(quantile_cont(abs(y_true - y_pred), 0.95), 2) + 0.0 AS p95_abs_error FROM {PREDICTIONS} p GROUP BY 1, 2""",
)
def error_distribution(spark, sf):
    from tidecast.operators.quantiles import exact_quantiles

    by = ["case_id", "model"]
    e = materialise(ev.errors(predictions(spark, sf)), "errors")
    signed = exact_quantiles(e, "error", [0.5], by).select(*by, F.col("q").alias("median_error"))
    size = (
        exact_quantiles(e, "abs_error", [0.5, 0.95], by)
        .groupBy(*by)
        .agg(
            F.max(F.when(F.col("prob") == 0.5, F.col("q"))).alias("median_abs_error"),
            F.max(F.when(F.col("prob") == 0.95, F.col("q"))).alias("p95_abs_error"),
        )
    )
    return rounded(signed.join(size, by), 2)


@query(
    "j10_peak_comparison",
    f"""SELECT wk, y, round(q, 2) + 0.0 AS threshold, round(p, 2) + 0.0 AS y_pred FROM (SELECT wk, sum(y) AS y FROM {F2} a GROUP BY 1) t
        JOIN (SELECT wk + 1 AS wk, sum(y) AS p FROM {F2} b GROUP BY 1) f USING (wk),
        (SELECT quantile_cont(y, 0.75) AS q FROM (SELECT sum(y) AS y FROM {F2} c GROUP BY wk) g) z WHERE y >= q""",
)
def peak_comparison(spark, sf):
    totals = agg.rollup(weekly(spark, sf), ["wk"], y=F.sum("y"))
    predicted = totals.select((F.col("wk") + 1).alias("wk"), F.col("y").alias("y_pred"))
    return rounded(ev.peak_comparison(totals, predicted, "wk", "y").select("wk", "y", "threshold", "y_pred"), 2)


POSITIONED = f"(SELECT *, row_number() OVER (ORDER BY t) - 1 AS pos, cast(floor(count(*) OVER () * 0.8) AS int) AS n_train FROM {LINE} l)"


@query(
    "j11_accuracy_by_size",
    f"""SELECT 'LinearRegression' AS model, size, round(sqrt(avg(pow(y - (a + b * x), 2))), 2) + 0.0 AS rmse FROM {POSITIONED} t,
        (SELECT cast(size AS double) AS size, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM {POSITIONED} p
         JOIN (VALUES (0.25), (0.5), (0.75), (1.0)) s(size) ON pos < floor(n_train * size) GROUP BY 1) f WHERE pos >= n_train GROUP BY 2""",
)
def accuracy_by_size(spark, sf):
    rows = temporal_split(daily_line(spark, sf), "t", 0.8)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    table = regress.accuracy_by_size(
        train, test, "t", ["x"], "y", {"LinearRegression": regress.linear("y")}, [0.25, 0.5, 0.75, 1.0], ["t"]
    )
    return rounded(spark.createDataFrame(table, "model string, size double, rmse double"), 2)


@query(
    "j12_leakage_flags",
    f"""SELECT name, 'outcome column' AS reason FROM (VALUES ('l_returnflag'), ('l_linestatus'), ('l_shipdate'), ('leak')) d(name)
        UNION ALL SELECT 'leak', 'correlation' FROM (SELECT corr(leak, l_quantity) AS c FROM {F3} x) z WHERE abs(c) > 0.95""",
)
def leakage_flags(spark, sf):
    return ev.leakage_flags(lines(spark, sf), "l_quantity", list(LINES.denied))


ABLATION = f"""(SELECT *, CASE WHEN t <= DATE '2000-06-01' THEN 'train' ELSE 'test' END AS split FROM {F4} m)"""


@query(
    "j13_leakage_ablation",
    f"""WITH s AS (SELECT count(*) AS n, avg(price) AS mu, avg(leak) AS mv, avg(y) AS my, covar_pop(price, price) AS uu, covar_pop(leak, leak) AS vv,
          covar_pop(price, leak) AS uv, covar_pop(price, y) AS uy, covar_pop(leak, y) AS vy FROM {ABLATION} a WHERE split = 'train'),
        c AS (SELECT uy / uu AS b, (vv * uy - uv * vy) / (uu * vv - uv * uv) AS b1, (uu * vy - uv * uy) / (uu * vv - uv * uv) AS b2, mu, mv, my FROM s),
        m AS (SELECT 1 - sum(pow(y - (my + b * (price - mu)), 2)) / (var_pop(y) * count(*)) AS r2_without,
          1 - sum(pow(y - (my + b1 * (price - mu) + b2 * (leak - mv)), 2)) / (var_pop(y) * count(*)) AS r2_with FROM {ABLATION} t, c WHERE split = 'test')
        SELECT round(r2_without, 4) + 0.0 AS r2_without, round(r2_with, 4) + 0.0 AS r2_with, round(r2_with - r2_without, 4) + 0.0 AS gain FROM m""",
)
def leakage_ablation(spark, sf):
    rows = monthly(spark, sf).withColumn("split", F.when(F.col("t") <= "2000-06-01", "train").otherwise("test"))
    rows = materialise(rows, "panel")
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    out = regress.leakage_ablation(train, test, ["price"], "leak", "y", regress.linear("y"))
    return rounded(out, 4)
