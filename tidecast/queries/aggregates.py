"""E: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidecast.operators import aggregate as agg
from tidecast.operators.evaluate import period_totals
from tidecast.operators.joins import align
from tidecast.queries.projections import GAPS, with_gaps
from tidecast.queries.registry import (
    F1,
    F2,
    F3,
    F4,
    RESULTS,
    daily,
    days,
    lines,
    monthly,
    query,
    r,
    read,
    results,
    rounded,
    weekly,
    PREDICTIONS,
    predictions,
)
from tidecast.session import materialise


@query("e01_daily_sum", f"SELECT cast(t AS varchar) AS t, y FROM {F1} x")
def daily_sum(spark, sf):
    orders = read(spark, sf, "orders").withColumn("t", days("o_orderdate"))
    return rounded(agg.rollup(orders, ["t"], y=agg.money_sum("o_totalprice")), 2)


@query(
    "e02_daily_mean",
    """SELECT cast(cast(l_shipdate AS date) AS varchar) AS t, round(avg(l_quantity), 6) + 0.0 AS y FROM lineitem GROUP BY 1""",
)
def daily_mean(spark, sf):
    line = read(spark, sf, "lineitem").withColumn("t", days("l_shipdate"))
    return rounded(agg.rollup(line, ["t"], y=agg.money_mean("l_quantity")))


@query(
    "e03_weekly_sum",
    f"""SELECT wk, sum(y) AS y, (SELECT count(DISTINCT wk) FROM {F2} h) AS horizon FROM {F2} x GROUP BY 1""",
)
def weekly_sum(spark, sf):
    df = agg.rollup(weekly(spark, sf), ["wk"], y=F.sum("y"))
    return df.withColumn("horizon", F.lit(df.agg(F.count_distinct("wk")).first()[0]))


@query(
    "e04_exogenous_means",
    f"""SELECT wk, round(avg(checkout_price), 4) + 0.0 AS checkout_price, round(avg(base_price), 4) + 0.0 AS base_price,
        round(avg(emailer), 6) + 0.0 AS emailer, round(avg(homepage), 6) + 0.0 AS homepage FROM {F2} x GROUP BY 1""",
)
def exogenous_means(spark, sf):
    cols = ("checkout_price", "base_price")
    flags = ("emailer", "homepage")
    df = agg.rollup(weekly(spark, sf), ["wk"], **{c: F.avg(c) for c in (*cols, *flags)})
    return df.select("wk", *[r(c, 4).alias(c) for c in cols], *[r(c).alias(c) for c in flags])


@query(
    "e05_prediction_rollup",
    f"""SELECT wk, round(sum(y), 2) + 0.0 AS y_true, round(sum(p), 2) + 0.0 AS y_pred FROM
        (SELECT wk, y, lag(y) OVER (PARTITION BY r_name, c_mktsegment ORDER BY wk) AS p FROM {F2} x) z
        WHERE p IS NOT NULL GROUP BY 1""",
)
def prediction_rollup(spark, sf):
    df = weekly(spark, sf)
    w = W.partitionBy("r_name", "c_mktsegment").orderBy("wk")
    keys = ["r_name", "c_mktsegment", "wk"]
    forecast = df.select(*keys, F.lag("y").over(w).alias("y_pred")).where("y_pred IS NOT NULL")
    pairs = align(df.select(*keys, F.col("y").alias("y_true")), forecast, keys)
    return rounded(period_totals(pairs, ["wk"]), 2)


@query(
    "e06_metric_summary",
    f"""SELECT case_id, round(min(mae), 4) + 0.0 AS mae_min, round(avg(mae), 4) + 0.0 AS mae_mean, round(min(rmse), 4) + 0.0 AS rmse_min,
        round(avg(rmse), 4) + 0.0 AS rmse_mean, round(max(r2), 4) + 0.0 AS r2_max, round(avg(r2), 4) + 0.0 AS r2_mean FROM {RESULTS} x GROUP BY 1""",
)
def metric_summary(spark, sf):
    return rounded(agg.metric_summary(results(spark, sf)), 4)


@query(
    "e07_metric_pivot",
    "SELECT model, "
    + ", ".join(
        f"round(avg(CASE WHEN case_id = '{c}' THEN {m} END), 3) + 0.0 AS {c}_{m}"
        for c in ("case1", "case2", "case3", "case4")
        for m in ("mae", "rmse", "r2")
    )
    + f" FROM {RESULTS} x GROUP BY 1",
)
def metric_pivot(spark, sf):
    return rounded(agg.metric_pivot(results(spark, sf), ["mae", "rmse", "r2"], ["case1", "case2", "case3", "case4"]), 3)


@query(
    "e08_dataset_summary",
    f"""SELECT n_rows, cast(3 AS bigint) AS n_cols, missing_total, round(100.0 * missing_total / (n_rows * 3), 6) + 0.0 AS missing_pct FROM
        (SELECT count(*) AS n_rows, cast(2 * count(*) - count(price) - count(priority) AS bigint) AS missing_total FROM {GAPS} g) z""",
)
def dataset_summary(spark, sf):
    return rounded(agg.dataset_summary(with_gaps(spark, sf)))


@query(
    "e09_target_profile",
    """SELECT round(min(c_acctbal), 4) + 0.0 AS y_min, round(max(c_acctbal), 4) + 0.0 AS y_max, round(avg(c_acctbal), 4) + 0.0 AS y_mean,
       round(quantile_cont(c_acctbal, 0.5), 4) + 0.0 AS y_median, round(stddev_pop(c_acctbal), 4) + 0.0 AS y_std,
       count(*) FILTER (WHERE c_acctbal = 0) AS zeros, count(*) FILTER (WHERE c_acctbal < 0) AS negatives FROM customer""",
)
def target_profile(spark, sf):
    return rounded(agg.target_profile(read(spark, sf, "customer"), "c_acctbal"), 4)


@query(
    "e10_cardinalities",
    """SELECT 'p_name' AS name, count(DISTINCT p_name) AS n_distinct FROM part UNION ALL
       SELECT 'p_brand', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part""",
)
def cardinalities(spark, sf):
    return agg.cardinalities(read(spark, sf, "part"))


NUMERIC = ("l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice", "c_acctbal", "leak", "l_linenumber", "l_orderkey", "l_partkey", "l_suppkey")


@query(
    "e11_target_correlations",
    "SELECT name, corr FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS name, round(corr({c}, l_quantity), 6) + 0.0 AS corr FROM {F3} x" for c in NUMERIC)
    + ") z ORDER BY abs(corr) DESC, name LIMIT 8",
)
def target_correlations(spark, sf):
    return rounded(agg.top_correlations(lines(spark, sf), "l_quantity"))


MATRIX = ["y", "price", "competitor", "discount", "inventory"]


@query(
    "e12_correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) + 0.0 AS corr FROM {F4} f"
        for i, a in enumerate(MATRIX)
        for b in MATRIX[: i + 1]
    ),
)
def correlation_matrix(spark, sf):
    return rounded(agg.correlation_matrix(monthly(spark, sf), MATRIX))


@query(
    "e13_peak_flag",
    f"""SELECT cast(t AS varchar) AS t, y, round(q, 2) + 0.0 AS threshold, CASE WHEN y >= q THEN 1 ELSE 0 END AS is_peak
        FROM {F1} x, (SELECT quantile_cont(y, 0.75) AS q FROM {F1} z) f""",
)
def peak_flag(spark, sf):
    return rounded(agg.peak_flag(daily(spark, sf).drop("series_id"), "y"), 2)


@query(
    "e14_histogram",
    f"""SELECT model, bin, round(lo + bin * w, 2) + 0.0 AS bin_start, n, round(n / (total * w), 9) + 0.0 AS density FROM
        (SELECT model, lo, w, total, least(cast(floor((e - lo) / w) AS int), 19) AS bin, count(*) AS n FROM
        (SELECT model, y_true - y_pred AS e FROM {PREDICTIONS} p) a JOIN (SELECT model, min(e) AS lo, (max(e) - min(e)) / 20 AS w, count(*) AS total
        FROM (SELECT model, y_true - y_pred AS e FROM {PREDICTIONS} q) b GROUP BY 1) s USING (model) GROUP BY 1, 2, 3, 4, 5) h""",
)
def histogram(spark, sf):
    df = predictions(spark, sf).withColumn("e", F.col("y_true") - F.col("y_pred"))
    out = agg.histogram(df, "e", 20, ["model"])
    return out.select("model", "bin", r("bin_start", 2).alias("bin_start"), "n", r("density", 9).alias("density"))


@query(
    "e15_density",
    """SELECT i, round(lo + i * step, 6) + 0.0 AS x, round(sum(c * exp(-0.5 * pow((lo + i * step - v) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 6) + 0.0 AS density
       FROM (SELECT l_quantity AS v, count(*) AS c FROM lineitem GROUP BY 1) d,
       (SELECT n, bw, a - 3 * bw AS lo, (b + 3 * bw - (a - 3 * bw)) / 49 AS step FROM
         (SELECT count(*) AS n, stddev_samp(l_quantity) * pow(count(*), -0.2) AS bw, min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem) q) s,
       (SELECT unnest(generate_series(0, 49)) AS i) g GROUP BY 1, 2""",
)
def density(spark, sf):
    return rounded(agg.kernel_density(read(spark, sf, "lineitem"), "l_quantity", 50))


@query(
    "e16_box_summary",
    """SELECT event_type, round(q1, 6) + 0.0 AS q1, round(median, 6) + 0.0 AS median, round(q3, 6) + 0.0 AS q3,
       min(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
       max(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
       count(*) FILTER (WHERE value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
       FROM events JOIN (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
       quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) q USING (event_type) GROUP BY event_type, q1, median, q3""",
)
def box_summary(spark, sf):
    return rounded(agg.box_summary(read(spark, sf, "events"), "value", ["event_type"]))


@query(
    "e17_lag_regression",
    f"""SELECT round(regr_slope(y, p), 6) + 0.0 AS slope, round(regr_intercept(y, p), 2) + 0.0 AS intercept, round(regr_r2(y, p), 6) + 0.0 AS r2
        FROM (SELECT y, lag(y) OVER (ORDER BY t) AS p FROM {F1} x) z""",
)
def lag_regression(spark, sf):
    df = daily(spark, sf).withColumn("p", F.lag("y").over(W.partitionBy("series_id").orderBy("t")))
    fit = agg.simple_regression(df, "y", "p")
    return fit.select(r("slope").alias("slope"), r("intercept", 2).alias("intercept"), r("r2").alias("r2"))


@query(
    "e18_best_model",
    f"""SELECT case_id, 'rmse' AS metric, arg_min(model, rmse) AS best_model FROM {RESULTS} x GROUP BY 1
        UNION ALL SELECT case_id, 'r2', arg_max(model, r2) FROM {RESULTS} y GROUP BY 1""",
)
def best_model(spark, sf):
    rows = materialise(results(spark, sf), "results")
    picks = [agg.best_model(rows, m).select("case_id", F.lit(m).alias("metric"), "best_model") for m in ("rmse", "r2")]
    return picks[0].unionByName(picks[1])


@query(
    "e19_inventory",
    f"SELECT DISTINCT 'model' AS kind, model AS name FROM {RESULTS} x UNION ALL SELECT DISTINCT 'case_id', case_id FROM {RESULTS} y",
)
def inventory(spark, sf):
    rows = materialise(results(spark, sf), "results")
    parts = [agg.inventory(rows, c).select(F.lit(c).alias("kind"), F.col(c).alias("name")) for c in ("model", "case_id")]
    return parts[0].unionByName(parts[1])
