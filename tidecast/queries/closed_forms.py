"""Models in settings whose result SQL can compute: the same library code as the larger queries.

A tree of depth one is a pair of group means, a boosting step is a pair of means of what is left, an
order of an ARMA model without moving averages is a regression line, a network without a hidden
layer on standardised numbers is known from a correlation.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidecast.models import arima, boosting, forecast, minibatch, network, regress
from tidecast.operators import split
from tidecast.operators.encode import ordered_statistic
from tidecast.plans import experiment
from tidecast.queries.registry import (
    F2,
    F4,
    F5,
    PREDICTIONS,
    all_series,
    event_days,
    hash_sql,
    monthly,
    query,
    r,
    read,
    rounded,
    weekly,
)
from tidecast.queries.scans import LINE, daily_line
from tidecast.session import fresh_path, keep, materialise
from tidecast.sources import models as saved

EVENT = ["event_type"]
PANEL = ["r_name", "c_mktsegment"]
KEY4 = ["s_nationkey", "p_type", "t"]
BEFORE = "1999-01-01"

# Entity panel with two 0/1 features and its parts: training, validation and test months.
FLAGS = f"""(SELECT s_nationkey, p_type, t, y, cast(discount > 5 AS int) AS a, cast(price > competitor AS int) AS b,
  CASE WHEN t < DATE '{BEFORE}' THEN 'train' WHEN t < DATE '2000-01-01' THEN 'val' ELSE 'test' END AS part FROM {F4} x)"""


def flags(spark, sf):
    part = F.when(F.col("t") < BEFORE, "train").when(F.col("t") < "2000-01-01", "val").otherwise("test")
    a, b = (F.col("discount") > 5).cast("int"), (F.col("price") > F.col("competitor")).cast("int")
    return keep(monthly(spark, sf).select("s_nationkey", "p_type", "t", "y", a.alias("a"), b.alias("b"), part.alias("part")))


# The better first split of the training rows: the one whose group means explain more.
FIRST = f"""(SELECT CASE WHEN sum(CASE WHEN f = 'a' THEN n * m * m END) >= sum(CASE WHEN f = 'b' THEN n * m * m END) THEN 'a' ELSE 'b' END AS best FROM
  (SELECT 'a' AS f, count(*) AS n, avg(y) AS m FROM {FLAGS} x WHERE part = 'train' GROUP BY a
   UNION ALL SELECT 'b', count(*), avg(y) FROM {FLAGS} z WHERE part = 'train' GROUP BY b) g)"""
# Every row with the first tree's prediction, what is left, and the second tree's on twice that.
STEP1 = f"""(SELECT d.*, m.m AS f1, d.y - m.m AS e1 FROM {FLAGS} d, {FIRST} c, (SELECT f, v, avg(y) AS m FROM
    (SELECT 'a' AS f, a AS v, y FROM {FLAGS} x WHERE part = 'train' UNION ALL SELECT 'b', b, y FROM {FLAGS} z WHERE part = 'train') u GROUP BY 1, 2) m
  WHERE m.f = c.best AND m.v = CASE WHEN c.best = 'a' THEN d.a ELSE d.b END)"""
SECOND = f"""(SELECT f, v, avg(2 * e1) AS m, count(*) AS n FROM (SELECT 'a' AS f, a AS v, e1 FROM {STEP1} x WHERE part = 'train'
  UNION ALL SELECT 'b', b, e1 FROM {STEP1} z WHERE part = 'train') u GROUP BY 1, 2)"""
STEP2 = f"""(SELECT d.*, d.f1 + 0.5 * s.m AS f2 FROM {STEP1} d, (SELECT CASE WHEN sum(CASE WHEN f = 'a' THEN n * m * m END) >= sum(CASE WHEN f = 'b' THEN n * m * m END) THEN 'a' ELSE 'b' END AS best
   FROM {SECOND} g) c, {SECOND} s WHERE s.f = c.best AND s.v = CASE WHEN c.best = 'a' THEN d.a ELSE d.b END)"""

STUMP = {"numTrees": 1, "maxDepth": 1, "minInstancesPerNode": 1, "bootstrap": False}
TWO_STEPS = {"maxIter": 2, "maxDepth": 1, "stepSize": 0.5, "subsamplingRate": 1.0, "minInstancesPerNode": 1}


def two_steps():
    return regress.boosting("y", **TWO_STEPS).setFeatureSubsetStrategy("all")


@query(
    "a13_configured_parameters",
    f"""SELECT * FROM (VALUES ('case1', 'LinearRegression', 'elasticNetParam', '0.0'), ('case1', 'LinearRegression', 'n_features', '1'), ('case1', 'LinearRegression', 'regParam', '0.0'),
        ('case1', 'RandomForest', 'maxDepth', '4'), ('case1', 'RandomForest', 'minInstancesPerNode', '2'), ('case1', 'RandomForest', 'n_features', '1'))
        v(case_id, model, parameter, value) WHERE EXISTS (SELECT 1 FROM {LINE} x)""",
)
def configured_parameters(spark, sf):
    rows = keep(daily_line(spark, sf))
    models = {
        ("case1", "LinearRegression"): regress.fit(rows, ["x"], regress.linear("y")),
        ("case1", "RandomForest"): regress.fit(rows, ["x"], regress.forest("y", numTrees=5, maxDepth=4)),
    }
    rows.unpersist()
    shown = ["elasticNetParam", "n_features", "regParam", "maxDepth", "minInstancesPerNode"]
    return saved.model_configurations(spark, models).where(F.col("parameter").isin(shown))


@query(
    "g01_tied_rows",
    f"""SELECT split, event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM (SELECT *, CASE WHEN row_number() OVER
        (ORDER BY cast(ts AS date), {hash_sql('event_type')}, event_id) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split FROM events) x GROUP BY 1, 2""",
)
def tied_rows(spark, sf):
    """A key that many rows share: every row stays, once, and the sides have their exact sizes."""
    got = split.temporal_split(read(spark, sf, "events"), "ts", 0.8, whole_dates=False, key=["event_type"])
    return got.groupBy("split", "event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("k03_short_series", f"SELECT event_type, step, round(arg_max(y, t), 4) + 0.0 AS y_pred, 'fallback' AS status FROM {F5} x, (SELECT unnest(generate_series(1, 5)) AS step) s GROUP BY 1, 2")
def short_series(spark, sf):
    """A season longer than half of every series: each keeps a forecast, with its status."""
    arrays = forecast.series_arrays(event_days(spark, sf), EVENT, "t", "y")
    fitted = forecast.smooth(arrays, EVENT, forecast.smoothing_grid("add", "add", False, 20))
    return rounded(forecast.smoothing_forecast(forecast.pick_best(fitted, EVENT), EVENT, 5), 4)


@query(
    "k04_level_or_trend",
    f"""WITH RECURSIVE s AS (SELECT event_type, y, row_number() OVER w AS i, lead(y) OVER w - y AS ahead FROM {F5} x WINDOW w AS (PARTITION BY event_type ORDER BY t)),
        c AS (SELECT * FROM (VALUES ('none', 0.2::DOUBLE, 0.0::DOUBLE), ('none', 0.6, 0.0), ('add', 0.2, 0.1), ('add', 0.6, 0.4)) v(trend, alpha, beta)),
        f AS (SELECT event_type, trend, alpha, beta, cast(1 AS bigint) AS i, y AS level, CASE WHEN trend = 'add' THEN ahead ELSE 0 END AS slope, 0.0::DOUBLE AS sse FROM s, c WHERE i = 1
          UNION ALL SELECT f.event_type, trend, alpha, beta, s.i, alpha * s.y + (1 - alpha) * (level + slope),
            beta * (alpha * s.y + (1 - alpha) * (level + slope) - level) + (1 - beta) * slope, sse + pow(s.y - level - slope, 2)
          FROM f JOIN s ON s.event_type = f.event_type AND s.i = f.i + 1),
        e AS (SELECT event_type, trend, alpha, beta, max(i) - 1 AS n, arg_max(sse, i) AS sse, arg_max(level, i) AS level, arg_max(slope, i) AS slope FROM f GROUP BY ALL),
        a AS (SELECT *, n * ln(sse / n) + CASE WHEN trend = 'add' THEN 8 ELSE 4 END AS aic FROM e)
        SELECT event_type, arg_min(trend, aic) AS trend, arg_min(alpha, aic) AS alpha, arg_min(beta, aic) AS beta, round(min(aic), 6) + 0.0 AS aic,
          round(arg_min(level + 3 * slope, aic), 4) + 0.0 AS third FROM a GROUP BY 1""",
)
def level_or_trend(spark, sf):
    arrays = forecast.series_arrays(event_days(spark, sf), EVENT, "t", "y")
    candidates = [c for t, a, b in ((None, 0.2, 0.0), (None, 0.6, 0.0), ("add", 0.2, 0.1), ("add", 0.6, 0.4)) for c in forecast.smoothing_grid(t, None, False, 1, alphas=(a,), betas=(b,))]
    best = forecast.pick_best(forecast.smooth(arrays, EVENT, candidates), EVENT)
    third = F.col("level") + 3 * F.col("slope")
    return best.select("event_type", "trend", "alpha", "beta", r("aic").alias("aic"), r(third, 4).alias("third"))


# Weekly panel series with first and second differences.
DIFFS = f"""(SELECT *, dy - lag(dy) OVER w AS ddy, lag(dy) OVER w AS ldy FROM
  (SELECT r_name, c_mktsegment, wk, y, row_number() OVER v AS i, count(*) OVER (PARTITION BY r_name, c_mktsegment) AS n, lag(y) OVER v AS ly, y - lag(y) OVER v AS dy
   FROM {F2} x WINDOW v AS (PARTITION BY r_name, c_mktsegment ORDER BY wk)) d WINDOW w AS (PARTITION BY r_name, c_mktsegment ORDER BY wk))"""


def t_ratio(dy: str, level: str) -> str:
    slope = f"regr_slope({dy}, {level})"
    left = f"(regr_syy({dy}, {level}) - {slope} * regr_sxy({dy}, {level}))"
    return f"{slope} / sqrt({left} / (regr_count({dy}, {level}) - 2) / regr_sxx({dy}, {level}))"


@query(
    "k05_unit_root",
    f"""SELECT r_name, c_mktsegment, cast(CASE WHEN {t_ratio('dy', 'ly')} < {arima.UNIT_ROOT_5PCT} THEN 0 WHEN {t_ratio('ddy', 'ldy')} < {arima.UNIT_ROOT_5PCT} THEN 1 ELSE 2 END AS int) AS d,
        cast(count(*) AS int) AS n FROM {DIFFS} x GROUP BY 1, 2""",
)
def unit_root(spark, sf):
    return arima.difference_orders(weekly(spark, sf), PANEL, "wk", "y", lags=0)


@query(
    "k06_autoregression",
    f"""WITH RECURSIVE s AS (SELECT * FROM {DIFFS} x), b AS (SELECT r_name, c_mktsegment, regr_slope(dy, ldy) AS b, regr_intercept(dy, ldy) AS a FROM s GROUP BY 1, 2),
        f AS (SELECT r_name, c_mktsegment, 0 AS step, y AS level, dy FROM s WHERE i = n
          UNION ALL SELECT r_name, c_mktsegment, step + 1, level + a + b * dy, a + b * dy FROM f JOIN b USING (r_name, c_mktsegment) WHERE step < 10)
        SELECT r_name, c_mktsegment, step, round(level, 4) + 0.0 AS y_pred, 'fitted' AS status FROM f WHERE step > 0""",
)
def autoregression(spark, sf):
    fits = arima.fit_orders(weekly(spark, sf), None, PANEL, "wk", "y", [(1, 1, 0, 0, 0, 0, 1)], 10)
    return rounded(arima.order_forecast(fits, PANEL), 4)


@query(
    "k07_walk_or_autoregression",
    f"""SELECT r_name, c_mktsegment, cast(CASE WHEN a1 < a0 THEN 1 ELSE 0 END AS int) AS p, round(least(a0, a1), 4) + 0.0 AS aic FROM (SELECT r_name, c_mktsegment,
        regr_count(dy, ldy) * ln(regr_syy(dy, ldy) / regr_count(dy, ldy)) + 4 AS a0,
        regr_count(dy, ldy) * ln((regr_syy(dy, ldy) - regr_slope(dy, ldy) * regr_sxy(dy, ldy)) / regr_count(dy, ldy)) + 6 AS a1 FROM {DIFFS} x GROUP BY 1, 2) z""",
)
def walk_or_autoregression(spark, sf):
    fits = arima.fit_orders(weekly(spark, sf), None, PANEL, "wk", "y", [(0, 1, 0, 0, 0, 0, 1), (1, 1, 0, 0, 0, 0, 1)], 10)
    return rounded(arima.best_order(fits, PANEL).select(*PANEL, "p", "aic"), 4)


# First differences and their difference over four weeks.
SEASONAL = f"""(SELECT *, lag(w) OVER v AS lw FROM (SELECT *, dy - lag(dy, 4) OVER u AS w FROM {DIFFS} x WINDOW u AS (PARTITION BY r_name, c_mktsegment ORDER BY wk)) z
  WINDOW v AS (PARTITION BY r_name, c_mktsegment ORDER BY wk))"""


@query(
    "k08_seasonal_walk",
    f"""WITH RECURSIVE s AS (SELECT *, lag(y, 2) OVER v AS y3, lag(y, 3) OVER v AS y4, lag(y, 4) OVER v AS y5 FROM {SEASONAL} x WINDOW v AS (PARTITION BY r_name, c_mktsegment ORDER BY wk)),
        m AS (SELECT r_name, c_mktsegment, avg(w) AS m FROM s WHERE lw IS NOT NULL GROUP BY 1, 2),
        f AS (SELECT r_name, c_mktsegment, 0 AS step, y AS y1, ly AS y2, y3, y4, y5 FROM s WHERE i = n
          UNION ALL SELECT r_name, c_mktsegment, step + 1, y1 + y4 - y5 + m, y1, y2, y3, y4 FROM f JOIN m USING (r_name, c_mktsegment) WHERE step < 10)
        SELECT r_name, c_mktsegment, step, round(y1, 4) + 0.0 AS y_pred, 'fitted' AS status FROM f WHERE step > 0""",
)
def seasonal_walk(spark, sf):
    fits = arima.fit_orders(weekly(spark, sf), None, PANEL, "wk", "y", [(0, 1, 0, 0, 1, 0, 4)], 10)
    return rounded(arima.order_forecast(fits, PANEL), 4)


@query(
    "k09_seasonal_walk_or_autoregression",
    f"""SELECT r_name, c_mktsegment, cast(CASE WHEN a1 < a0 THEN 1 ELSE 0 END AS int) AS p, round(least(a0, a1), 4) + 0.0 AS aic FROM (SELECT r_name, c_mktsegment,
        regr_count(w, lw) * ln(regr_syy(w, lw) / regr_count(w, lw)) + 4 AS a0,
        regr_count(w, lw) * ln((regr_syy(w, lw) - regr_slope(w, lw) * regr_sxy(w, lw)) / regr_count(w, lw)) + 6 AS a1 FROM {SEASONAL} x GROUP BY 1, 2) z""",
)
def seasonal_walk_or_autoregression(spark, sf):
    fits = arima.fit_orders(weekly(spark, sf), None, PANEL, "wk", "y", [(0, 1, 0, 0, 1, 0, 4), (1, 1, 0, 0, 1, 0, 4)], 10)
    return rounded(arima.best_order(fits, PANEL).select(*PANEL, "p", "aic"), 4)


@query(
    "k10_missing_features",
    f"""SELECT s_nationkey, p_type, cast(t AS varchar) AS t, CASE WHEN price <= competitor THEN round(a + b * inventory, 3) + 0.0 END AS y_pred,
        CASE WHEN price <= competitor THEN 'scored' ELSE 'missing features' END AS status FROM {F4} x,
        (SELECT regr_slope(y, inventory) AS b, regr_intercept(y, inventory) AS a FROM {F4} z WHERE price <= competitor) f""",
)
def missing_features(spark, sf):
    """Rows without a feature are left out of the fit and stay in the scores."""
    rows = keep(monthly(spark, sf).withColumn("inventory", F.when(F.col("price") <= F.col("competitor"), F.col("inventory"))).select(*KEY4, "y", "inventory"))
    out = regress.predict(regress.fit(rows, ["inventory"], regress.linear("y")), rows, status=True)
    return rounded(out.select(*KEY4, "y_pred", "status"), 3)


MEANS = f"(SELECT a, avg(y) AS m FROM {FLAGS} x WHERE part = 'train' GROUP BY 1)"


@query("k11_single_split", f"SELECT s_nationkey, p_type, cast(t AS varchar) AS t, round(m, 4) + 0.0 AS y_pred FROM {FLAGS} d JOIN {MEANS} g USING (a) WHERE part = 'test'")
def single_split(spark, sf):
    rows = flags(spark, sf)
    model = regress.fit(rows.where("part = 'train'"), ["a"], regress.forest("y", **STUMP))
    return rounded(regress.predict(model, rows.where("part = 'test'")).select(*KEY4, "y_pred"), 4)


@query("k12_two_steps", f"SELECT s_nationkey, p_type, cast(t AS varchar) AS t, round(f2, 4) + 0.0 AS y_pred FROM {STEP2} d WHERE part = 'test'")
def two_boosting_steps(spark, sf):
    rows = flags(spark, sf)
    model = regress.fit(rows.where("part = 'train'"), ["a", "b"], two_steps())
    return rounded(regress.predict(model, rows.where("part = 'test'")).select(*KEY4, "y_pred"), 4)


def second_order_sql(l2: float, rate: float, by: str) -> str:
    """Mean of the training rows, then a step of every group of ``by``: its gradient over its Hessian and the penalty."""
    return f"""SELECT d.*, m.m - {rate} * s.g / (s.h + {l2}) AS f1 FROM {FLAGS} d, (SELECT avg(y) AS m FROM {FLAGS} x WHERE part = 'train') m,
      (SELECT {by}, sum(k.m - y) AS g, count(*) AS h FROM {FLAGS} z, (SELECT avg(y) AS m FROM {FLAGS} x WHERE part = 'train') k WHERE part = 'train' GROUP BY {by}) s
      WHERE {" AND ".join(f"d.{c} = s.{c}" for c in by.split(", "))}"""


# The better first split under a penalty of 1: groups' squared gradients over their Hessians.
GAINS = f"""(SELECT f, sum(g * g / (h + 1)) AS q FROM (SELECT 'a' AS f, a AS v, sum(m - y) AS g, count(*) AS h FROM {FLAGS} x, (SELECT avg(y) AS m FROM {FLAGS} z WHERE part = 'train') k
    WHERE part = 'train' GROUP BY a UNION ALL SELECT 'b', b, sum(m - y), count(*) FROM {FLAGS} x, (SELECT avg(y) AS m FROM {FLAGS} z WHERE part = 'train') k WHERE part = 'train' GROUP BY b) e GROUP BY f)"""
ONE_SPLIT = f"""(SELECT * FROM ({second_order_sql(1.0, 0.5, 'a')}) p WHERE (SELECT max(CASE WHEN f = 'a' THEN q END) >= max(CASE WHEN f = 'b' THEN q END) FROM {GAINS} g)
  UNION ALL SELECT * FROM ({second_order_sql(1.0, 0.5, 'b')}) p WHERE (SELECT max(CASE WHEN f = 'a' THEN q END) < max(CASE WHEN f = 'b' THEN q END) FROM {GAINS} g))"""
WHOLE = {"rate": 0.5, "least_weight": 0.0, "row_share": 1.0, "column_share": 1.0}


def second_order(spark, sf, **conf):
    rows = flags(spark, sf)
    model = boosting.train_boosted(rows.where("part = 'train'"), ["a", "b"], "y", **{**WHOLE, **conf})
    return model, rounded(boosting.boosted_predict(model, rows.where("part = 'test'")).select(*KEY4, "y_pred"), 4)


@query("k12_second_order_split", f"SELECT s_nationkey, p_type, cast(t AS varchar) AS t, round(f1, 4) + 0.0 AS y_pred FROM {ONE_SPLIT} d WHERE part = 'test'")
def second_order_split(spark, sf):
    return second_order(spark, sf, trees=1, depth=1, l2=1.0)[1]


@query("k12_second_order_depth_two", f"SELECT s_nationkey, p_type, cast(t AS varchar) AS t, round(f1, 4) + 0.0 AS y_pred FROM ({second_order_sql(1.0, 0.5, 'a, b')}) d WHERE part = 'test'")
def second_order_depth_two(spark, sf):
    """Two flags part the rows into four groups, whichever comes first; without a least gain every split is made."""
    return second_order(spark, sf, trees=1, depth=2, l2=1.0, least_gain=-math.inf)[1]


@query("k13_symmetric_tree", f"SELECT s_nationkey, p_type, cast(t AS varchar) AS t, round(f1, 4) + 0.0 AS y_pred FROM ({second_order_sql(3.0, 0.5, 'a, b')}) d WHERE part = 'test'")
def symmetric_tree(spark, sf):
    return second_order(spark, sf, trees=1, depth=2, l2=3.0, symmetric=True, least_gain=-math.inf)[1]


@query(
    "k14_second_order_history",
    f"""SELECT 1 AS step, round(avg(CASE WHEN part = 'train' THEN pow(y - f1, 2) END), 4) + 0.0 AS loss, round(avg(CASE WHEN part = 'val' THEN pow(y - f1, 2) END), 4) + 0.0 AS val_loss FROM {ONE_SPLIT} d""",
)
def second_order_history(spark, sf):
    rows = flags(spark, sf)
    model = boosting.train_boosted(rows.where("part = 'train'"), ["a", "b"], "y", trees=1, depth=1, val=rows.where("part = 'val'"), **WHOLE)
    return rounded(spark.createDataFrame(model.history, "step int, loss double, val_loss double"), 4)


@query(
    "k13_fine_target",
    f"""SELECT o_orderkey, round((coalesce(sum(y) OVER w, 0) + g) / (count(*) OVER w + 1), 6) + 0.0 AS o_orderpriority_ordered
        FROM (SELECT o_orderkey, o_orderpriority, ln(1 + o_totalprice) / 1000 AS y FROM orders) o, (SELECT avg(ln(1 + o_totalprice) / 1000) AS g FROM orders) f
        WINDOW w AS (PARTITION BY o_orderpriority ORDER BY {hash_sql('o_orderkey')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def fine_target(spark, sf):
    """A logarithmic target far below a hundredth."""
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", (F.log1p("o_totalprice") / 1000).alias("y"))
    out = ordered_statistic(orders, "o_orderpriority", "y", ["o_orderkey"])
    return rounded(out.select("o_orderkey", "o_orderpriority_ordered"), 6)


LOSSES = f"""(SELECT 1 AS step, avg(CASE WHEN part = 'train' THEN e1 * e1 END) AS loss, avg(CASE WHEN part = 'val' THEN e1 * e1 END) AS val_loss FROM {STEP1} x
  UNION ALL SELECT 2, avg(CASE WHEN part = 'train' THEN pow(y - f2, 2) END), avg(CASE WHEN part = 'val' THEN pow(y - f2, 2) END) FROM {STEP2} z)"""


@query("k16_loss_by_step", f"SELECT step, round(loss, 4) + 0.0 AS loss, round(val_loss, 4) + 0.0 AS val_loss FROM {LOSSES} l")
def loss_by_step(spark, sf):
    rows = flags(spark, sf)
    train, val = rows.where("part = 'train'"), rows.where("part = 'val'")
    history = regress.training_history(regress.fit(train, ["a", "b"], two_steps()), train, val)
    return rounded(spark.createDataFrame(history, "step int, loss double, val_loss double"), 4)


@query("k14_best_prefix", f"SELECT cast(arg_min(step, val_loss) AS int) AS best_iteration, cast(arg_min(step, val_loss) AS int) AS trees FROM {LOSSES} l")
def best_prefix(spark, sf):
    rows = flags(spark, sf)
    model, best, _ = regress.early_stopping(rows.where("part = 'train'"), rows.where("part = 'val'"), ["a", "b"], two_steps())
    return spark.createDataFrame([(best, model.stages[-1].getNumTrees)], "best_iteration int, trees int")


# Start weight of a network with one input and no hidden layer, and its step.
W0, RATE = float(network.start_weights([1, 1], 42)[0][0, 0]), 0.1


@query(
    "k15_line_network",
    f"""WITH s AS (SELECT avg(inventory) AS mx, stddev_pop(inventory) AS sx, avg(y) AS my, stddev_pop(y) AS sy, corr(y, inventory) AS c FROM {F4} z),
        one AS (SELECT *, {W0} AS w0, 2 * ({W0} - c) AS g FROM s), two AS (SELECT *, w0 - {RATE} * g / (abs(g) + 1e-8) AS w1 FROM one),
        b AS (SELECT *, CASE WHEN abs(w1 - c) < abs(w0 - c) THEN w1 ELSE w0 END AS w FROM two)
        SELECT s_nationkey, p_type, cast(t AS varchar) AS t, round(w * (inventory - mx) / sx * sy + my, 2) + 0.0 AS y_pred FROM {F4} x, (SELECT mx, sx, my, sy, w FROM b) k""",
)
def line_network(spark, sf):
    """The start weight and one step from it: the better of the two is kept.

    A second step would amplify the rounding of the intercept's gradient, which is zero.
    """
    rows = keep(monthly(spark, sf).select(*KEY4, "y", "inventory"))
    net = network.train_network(rows, ["inventory"], "y", hidden=(), learning_rate=RATE, epochs=2, patience=5)
    return rounded(network.network_predict(net, rows.select(*KEY4, "inventory")).select(*KEY4, "y_pred"), 2)


@query(
    "k15_normalised_network",
    f"""WITH s AS (SELECT avg(inventory) AS mx, stddev_pop(inventory) AS sx, avg(y) AS my, stddev_pop(y) AS sy, corr(y, inventory) AS c, count(*) AS n FROM {F4} z),
        g AS (SELECT *, 1 / sqrt(1 + 1e-5) AS u, {W0} AS w0 FROM s),
        d AS (SELECT *, 2 * (w0 * u * u - c * u) AS dw, 2 * w0 * (w0 * u * u - c * u) AS dg FROM g),
        b AS (SELECT *, w0 - {RATE} * dw / (abs(dw) + 1e-8) AS w1, 1 - {RATE} * dg / (abs(dg) + 1e-8) AS g1, 1 / sqrt(0.9 + 0.1 * n / (n - 1) + 1e-5) AS v FROM d)
        SELECT s_nationkey, p_type, cast(t AS varchar) AS t, round((inventory - mx) / sx * v * g1 * w1 * sy + my, 2) + 0.0 AS y_pred FROM {F4} x, b""",
)
def normalised_network(spark, sf):
    """One mini-batch of all rows through a normalised input: its scale and its weight make a step, scoring uses the running moments."""
    rows = keep(monthly(spark, sf).select(*KEY4, "y", "inventory"))
    net = minibatch.train_minibatches(rows, ["inventory"], "y", hidden=(), learning_rate=RATE, epochs=1, patience=5, batch_size=1 << 40, shards=1)
    return rounded(minibatch.minibatch_predict(net, rows.select(*KEY4, "inventory")).select(*KEY4, "y_pred"), 2)


@query(
    "k16_network_history",
    f"""WITH s AS (SELECT corr(y, inventory) AS c FROM {F4} z), one AS (SELECT c, {W0} AS w0, 2 * ({W0} - c) AS g FROM s),
        two AS (SELECT c, w0, w0 - {RATE} * g / (abs(g) + 1e-8) AS w1 FROM one)
        SELECT 'case4' AS case_id, 'Line' AS model, step, round(pow(w - c, 2) + 1 - c * c, 6) + 0.0 AS loss, NULL::DOUBLE AS val_loss, abs(w - c) = least(abs(w0 - c), abs(w1 - c)) AS best
        FROM (SELECT 1 AS step, w0 AS w, * FROM two UNION ALL SELECT 2, w1, * FROM two) t""",
)
def network_history(spark, sf):
    """Saved, loaded, and its history as a table: squared error on standardised numbers by epoch."""
    rows = keep(monthly(spark, sf).select("y", "inventory"))
    net = network.train_network(rows, ["inventory"], "y", hidden=(), learning_rate=RATE, epochs=2, patience=5)
    path = fresh_path(spark, "network")
    saved.save_network(spark, net, path)
    return rounded(saved.training_histories(spark, {("case4", "Line"): saved.load_network(spark, path).history}))


@query(
    "a12_smoothing_state",
    f"""WITH RECURSIVE s AS (SELECT event_type, y, row_number() OVER (PARTITION BY event_type ORDER BY t) AS i FROM {F5} x),
        f AS (SELECT event_type, cast(1 AS bigint) AS i, y AS level FROM s WHERE i = 1
          UNION ALL SELECT f.event_type, s.i, 0.3 * s.y + 0.7 * f.level FROM f JOIN s ON s.event_type = f.event_type AND s.i = f.i + 1)
        SELECT event_type, step, round(arg_max(level, i), 4) + 0.0 AS y_pred, 'fitted' AS status FROM f, (SELECT unnest(generate_series(1, 3)) AS step) g GROUP BY 1, 2""",
)
def smoothing_state(spark, sf):
    """Fitted states saved as a table; the forecast comes from the loaded ones."""
    arrays = forecast.series_arrays(event_days(spark, sf), EVENT, "t", "y")
    best = forecast.pick_best(forecast.smooth(arrays, EVENT, forecast.smoothing_grid(None, None, False, 1, alphas=(0.3,))), EVENT)
    path = fresh_path(spark, "states")
    saved.save_states(best, path)
    return rounded(forecast.smoothing_forecast(saved.load_states(spark, path), EVENT, 3), 4)


@query(
    "k17_stump_importances",
    f"""SELECT m.model, m.kind, f.feature, CASE WHEN f.feature = best THEN 1.0 ELSE 0.0 END AS value FROM {FIRST} c,
        (VALUES ('RandomForest', 'weight'), ('XGBoost', 'weight'), ('XGBoost', 'splits')) m(model, kind), (VALUES ('a'), ('b')) f(feature)""",
)
def stump_importances(spark, sf):
    rows = flags(spark, sf).where("part = 'train'")
    out = []
    for name, e in (("RandomForest", regress.forest("y", **STUMP)), ("XGBoost", two_steps().setMaxIter(1))):
        model = regress.fit(rows, ["a", "b"], e)
        out += [(name, "weight", f, v) for f, v in regress.importances(model)]
        if name == "XGBoost":
            out += [(name, "splits", f, float(v)) for f, v in regress.split_counts(model)]
    return rounded(spark.createDataFrame(out, "model string, kind string, feature string, value double"))


@query(
    "k19_stump_search",
    f"""WITH d AS (SELECT y, a, cast(('0x' || substr({hash_sql('s_nationkey', 'p_type', 't')}, 1, 8)) AS bigint) % 3 AS fold FROM {FLAGS} x),
        m AS (SELECT k.fold, d.a, avg(d.y) AS m FROM d JOIN (SELECT DISTINCT fold FROM d) k ON d.fold <> k.fold GROUP BY 1, 2),
        e AS (SELECT d.fold, avg(pow(y - m, 2)) AS mse FROM d JOIN m USING (fold, a) GROUP BY 1)
        SELECT 'maxDepth=1, minInstancesPerNode=1, numTrees=1' AS params, round(avg(mse), 3) + 0.0 AS mse FROM e""",
)
def stump_search(spark, sf):
    space = {"maxDepth": [1], "minInstancesPerNode": [1], "numTrees": [1]}
    _, table = regress.random_search(flags(spark, sf), ["a"], regress.forest("y", bootstrap=False), space, KEY4, folds=3)
    return rounded(spark.createDataFrame(table, "params string, mse double"), 3)


LINES = ("price", "discount", "inventory")


@query(
    "k20_line_candidates",
    "WITH r AS ("
    + " UNION ALL ".join(
        f"""SELECT '{case}' AS case_id, '{x}' AS model, sqrt(avg(pow(y - a - b * x, 2))) AS rmse FROM (SELECT y, {x} AS x FROM {F4} d WHERE NOT ({where})) t,
        (SELECT regr_slope(y, {x}) AS b, regr_intercept(y, {x}) AS a FROM {F4} e WHERE {where}) f"""
        for case, where in (("early", f"t < DATE '{BEFORE}'"), ("low", "s_nationkey < 15"))
        for x in LINES
    )
    + ") SELECT model, cast(sum(rank) AS bigint) AS rank_sum FROM (SELECT *, rank() OVER (PARTITION BY case_id ORDER BY rmse) AS rank FROM r) z GROUP BY 1",
)
def line_candidates(spark, sf):
    rows = keep(monthly(spark, sf).select(*KEY4, "y", *LINES))
    tables = {n: (rows.where(c), rows.where(~c)) for n, c in (("early", F.col("t") < BEFORE), ("low", F.col("s_nationkey") < 15))}
    candidates = {x: (lambda case, train, test, x=x: regress.predict(regress.fit(train, [x], regress.linear("y")), test)) for x in LINES}
    return regress.candidate_search(tables, candidates, "y").select("model", F.col("rank_sum").cast("long").alias("rank_sum"))


PAIRS24 = f"""(SELECT model, y_true, y_pred FROM {PREDICTIONS} p WHERE case_id = 'case4' AND model <> 'LinearRegression'
  UNION ALL SELECT 'LinearRegression', y, a + b * inventory FROM {F4} d, (SELECT regr_slope(y, inventory) AS b, regr_intercept(y, inventory) AS a FROM {F4} e WHERE t < DATE '{BEFORE}') f
  WHERE t >= DATE '2000-01-01')"""


@query(
    "k24_simple_models",
    f"""SELECT 'case4' AS case_id, model, round(avg(abs(y_true - y_pred)), 3) + 0.0 AS mae, round(sqrt(avg(pow(y_true - y_pred, 2))), 3) + 0.0 AS rmse,
        count(*) AS n, cast(0 AS bigint) AS n_unscored, 'fitted' AS status FROM {PAIRS24} x GROUP BY 2""",
)
def simple_models(spark, sf):
    part = F.when(F.col("t") < BEFORE, "train").when(F.col("t") < "2000-01-01", "val").otherwise("test")
    e = experiment.Experiment(
        name="case4",
        series=materialise(all_series(spark, sf).where("case_id = 'case4'"), "series"),
        series_keys=["series_id"],
        season=12,
        rows=monthly(spark, sf).withColumn("split", part).drop("leak"),
        row_key=KEY4,
        features=["inventory"],
        label="y",
    )
    out = experiment.run(e, ["Naive", "SeasonalNaive", "LinearRegression"])
    return out.select("case_id", "model", r("mae", 3).alias("mae"), r("rmse", 3).alias("rmse"), "n", "n_unscored", "status")
