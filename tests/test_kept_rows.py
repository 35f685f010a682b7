"""Nothing is lost or changed silently: ties, gaps, fine numbers, short series, missing keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.models import arima, forecast, network, regress
from tidecast.operators import joins, split
from tidecast.operators.encode import full_statistic, ordered_statistic
from tidecast.plans import cases, cleaning
from tidecast.queries.registry import r
from tidecast.schemas import DAILY_SERIES, WEEKLY_PANEL
from tidecast.sources import models as saved
from tidecast.sources import tables
from test_cases import daily


def series(spark, data):
    return spark.createDataFrame([(k, i, float(v) if v is not None else None) for k, vals in data.items() for i, v in enumerate(vals)], "k string, t int, y double")


def test_rows_that_share_a_key_stay(spark):
    df = spark.range(40).select(F.lit("same").alias("key"), F.lit("2020-01-01").cast("date").alias("t"), F.col("id").alias("v"))
    got = split.temporal_split(df, "t", 0.5, whole_dates=False, key=["key"])
    assert sorted(x["v"] for x in got.collect()) == list(range(40))
    assert got.where("split = 'train'").count() == 20
    again = split.temporal_split(df.repartition(7), "t", 0.5, whole_dates=False, key=["key"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_rows_without_a_feature_are_scored_as_missing(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x double, y double")
    gaps = df.withColumn("x", F.when(F.col("x") % 5 != 0, F.col("x")).when(F.col("x") == 5, float("nan")))
    for estimator in (regress.linear("y"), regress.forest("y", numTrees=2, maxDepth=2), regress.boosting("y", maxIter=2)):
        out = regress.predict(regress.fit(gaps, ["x"], estimator), gaps, status=True)
        assert out.count() == 20 and regress.unscored(out) == 4 == out.where("status = 'missing features'").count()
    net = network.train_network(gaps, ["x"], "y", (4,), 0.01, 2, 2)
    assert network.network_predict(net, gaps).where("y_pred IS NULL").count() == 4


def test_first_trees_are_the_shorter_fit(spark):
    df = spark.range(200).selectExpr("cast(id as double) x", "cast(id % 7 + id / 50 as double) y")
    whole, short = (regress.fit(df, ["x"], regress.boosting("y", maxIter=n, subsamplingRate=1.0)) for n in (6, 3))
    cut = regress.first_trees(whole, 3)
    assert cut.stages[-1].getNumTrees == 3 and regress.importances(cut) == regress.importances(short)
    a, b = (sorted(x["y_pred"] for x in regress.predict(m, df).collect()) for m in (cut, short))
    assert a == b


def test_targets_keep_their_decimals(spark):
    df = spark.range(12).select("id", (F.col("id") % 2).alias("c"), F.lit(0.004).alias("y"))
    assert {round(x["c_ordered"], 9) for x in ordered_statistic(df, "c", "y", ["id"]).collect()} == {0.004}
    assert {round(x["c_ordered"], 9) for x in full_statistic(df, df, "c", "y").collect()} == {0.004}


def test_a_gap_in_training_is_no_horizon(spark):
    x = [0, 1, 0, 1] * 10
    y = [10 + 5 * v for v in x]
    train = series(spark, {"a": [None if i == 7 else v for i, v in enumerate(y[:36])]}).withColumn("x", F.lit(None).cast("double"))
    train = train.withColumn("x", (F.col("t") % 2).cast("double"))
    future = spark.createDataFrame([("a", 36 + i, float(x[36 + i])) for i in range(4)], "k string, t int, x double")
    got = arima.order_forecast(arima.fit_orders(train, future, ["k"], "t", "y", [(1, 0, 0, 0, 0, 0, 1)], 4, ["x"]), ["k"])
    assert [round(v["y_pred"], 6) for v in got.orderBy("step").collect()] == [10, 15, 10, 15]
    with pytest.raises(Exception, match="horizon"):
        arima.fit_orders(train, future, ["k"], "t", "y", [(1, 0, 0, 0, 0, 0, 1)], 3, ["x"]).collect()


def test_short_series_keep_a_row_with_a_status(spark):
    arrays = forecast.series_arrays(series(spark, {"long": range(40), "short": [1, 2, 9]}), ["k"], "t", "y")
    best = forecast.pick_best(forecast.smooth(arrays, ["k"], forecast.smoothing_grid("add", "add", False, 7)), ["k"])
    got = forecast.smoothing_forecast(best, ["k"], 2).collect()
    assert {(x["k"], x["status"]) for x in got} == {("long", "fitted"), ("short", "fallback")}
    assert [x["y_pred"] for x in got if x["k"] == "short"] == [9.0, 9.0]


@pytest.mark.parametrize("scale", [1e-3, 1e6])
def test_the_chosen_model_does_not_depend_on_the_unit(spark, scale):
    rng = np.random.default_rng(3)
    noise = {f"s{i}": (rng.normal(size=80) + 5).tolist() for i in range(3)}
    plain, scaled = series(spark, noise), series(spark, {k: [v * scale for v in vals] for k, vals in noise.items()})

    def smoothing(df):
        best = forecast.pick_best(forecast.smooth(forecast.series_arrays(df, ["k"], "t", "y"), ["k"], forecast.all_variants(7)), ["k"])
        return sorted(map(tuple, best.select("k", "trend", "seasonal", "alpha", "beta", "gamma").collect()))

    def orders(df):
        fits = arima.fit_orders(df, None, ["k"], "t", "y", arima.search_grid(2, 2, d=0), 3)
        return sorted(map(tuple, arima.best_order(fits, ["k"]).select("k", "p", "q").collect()))

    assert smoothing(plain) == smoothing(scaled) and orders(plain) == orders(scaled)


def test_candidates_beside_their_series_and_spread_agree(spark, monkeypatch):
    df = series(spark, {f"s{i}": np.random.default_rng(i).normal(size=50).cumsum().tolist() for i in range(4)})
    spread = arima.fit_orders(df, None, ["k"], "t", "y", arima.search_grid(1, 1), 3).orderBy("k", "p", "q").collect()
    monkeypatch.setattr(arima, "task_count", lambda _: 2)
    assert arima.fit_orders(df, None, ["k"], "t", "y", arima.search_grid(1, 1), 3).orderBy("k", "p", "q").collect() == spread


def test_all_files_of_a_case_are_read(spark, tmp_path):
    schema = spark.createDataFrame([], "model string, mae double").schema
    for folder, model in (("x", "A"), ("y", "B")):
        tables.write_csv(spark.createDataFrame([(model, 1.0)], schema), f"{tmp_path}/{folder}/case1_results.csv")
    got = tables.scan_case_files(spark, str(tmp_path), r"(case\d+)_results", schema).collect()
    assert sorted((x["case_id"], x["model"]) for x in got) == [("case1", "A"), ("case1", "B")]


def test_a_large_csv_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("k,v\n" + "".join(f"{i},some text of a row\n" for i in range(400_000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    try:
        assert tables.read_csv(spark, str(path)).rdd.getNumPartitions() > 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_rounding_does_not_saturate(spark):
    got = spark.createDataFrame([(3e13,), (-2.5,), (0.1234565,)], "x double").select(r("x").alias("x")).collect()
    assert [x["x"] for x in got] == [3e13, -2.5, 0.123457]


def plans(spark):
    return spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")


@pytest.fixture
def plain_joins(spark):
    before = plans(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
    spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_rows_without_a_key_are_dealt_out(spark, plain_joins):
    fact = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 5000).alias("k"), "id")
    dim = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    got = joins.lookup_join(fact, dim, ["k"], "left", broadcast_rows=0)
    sizes = [x["n"] for x in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 100_000 and max(sizes) <= 2 * sum(sizes) / int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert got.where("k IS NULL AND v IS NOT NULL").count() == 0 and got.where("k IS NOT NULL AND v <> k * 3").count() == 0
    assert joins.lookup_join(fact, dim, ["k"], "inner", broadcast_rows=0).count() == 50_000


def test_nested_lookups_scan_the_large_side_once(spark, plain_joins, tmp_path):
    spark.range(10_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100).alias("k"), (F.col("id") % 50).alias("j")).write.parquet(f"{tmp_path}/fact")
    fact = spark.read.parquet(f"{tmp_path}/fact")
    one, two = (spark.range(100).select(F.col("id").alias(k), (F.col("id") * n).alias(f"v{k}")) for k, n in (("k", 2), ("j", 5)))
    hot = joins.hot_keys(fact, ["k"], 0.1)
    assert hot == [(7,)]
    got = joins.lookup_join(joins.lookup_join(fact, one, ["k"], "left", 0, hot), two, ["j"], "left", 0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "SinglePartition" not in plan
    assert got.count() == 10_000 and got.where("vk <> k * 2 OR vj <> j * 5").count() == 0


def test_a_measured_lookup_is_counted_without_one_task(spark):
    spark._tidecast_sizes = {}
    df = spark.range(1000).select("id", F.repeat(F.lit("x"), 10).alias("s"))
    assert joins.fits_broadcast(df, 1000) and not joins.fits_broadcast(df, 999)
    assert len(spark._tidecast_sizes) == 1


def test_extreme_test_rows_leave_training_bounds_unchanged(spark):
    days = daily(spark)
    wild = days.withColumn("Order_Demand", F.when(F.col("Date") > "2015-07-01", 1e9).otherwise(F.col("Order_Demand")))

    def trained(raw, statistics):
        rows = cases.daily_case(raw, statistics=statistics).rows.where("split = 'train'")
        return sorted(x["order_demand"] for x in rows.select("order_demand").collect())

    assert trained(days, "train") == trained(wild, "train")
    top = {s: cases.daily_case(wild, statistics=s).rows.agg(F.max("order_demand")).first()[0] for s in ("train", "table")}
    assert top["train"] < 1000 and top["table"] == 1e9
    with pytest.raises(ValueError):
        cases.daily_case(days, statistics="test")


def test_a_missing_target_is_not_filled(spark):
    df = daily(spark).withColumn("Order_Demand", F.when(F.dayofmonth("Date") != 3, F.col("Order_Demand")))
    assert cleaning.clean_daily(df, DAILY_SERIES).where("Order_Demand IS NULL").count() == df.where("Order_Demand IS NULL").count() > 0
    week = spark.createDataFrame([(1, 1.0, None), (2, None, 5.0), (3, 3.0, 6.0)], "week int, base_price double, num_orders double")
    got = cleaning.clean_weekly(week, WEEKLY_PANEL).orderBy("week").collect()
    assert [x["num_orders"] for x in got] == [None, 5.0, 6.0] and got[1]["base_price"] == 2.0


def test_networks_and_states_are_saved_and_loaded(spark, tmp_path):
    rows = spark.range(50).selectExpr("cast(id as double) x", "cast(id * 2 as double) y")
    net = network.train_network(rows, ["x"], "y", (4, 3), 0.01, 3, 3, val=rows)
    saved.save_network(spark, net, f"{tmp_path}/net")
    back = saved.load_network(spark, f"{tmp_path}/net")
    assert back.history == net.history and back.best_epoch == net.best_epoch and back.features == net.features
    a, b = (sorted(x["y_pred"] for x in network.network_predict(n, rows).collect()) for n in (net, back))
    assert a == b
    table = saved.training_histories(spark, {("c", "n"): back.history}).collect()
    assert len(table) == 3 and sum(x["best"] for x in table) == 1
    conf = {x["parameter"]: x["value"] for x in saved.model_configurations(spark, {("c", "n"): back}).collect()}
    assert conf["hidden"] == "[4, 3]" and conf["n_features"] == "1"
    fits = arima.fit_orders(series(spark, {"a": range(40)}), None, ["k"], "t", "y", [(1, 1, 0, 0, 0, 0, 1)], 3)
    saved.save_states(fits, f"{tmp_path}/arma")
    loaded = arima.order_forecast(saved.load_states(spark, f"{tmp_path}/arma"), ["k"]).collect()
    assert sorted(map(tuple, loaded)) == sorted(map(tuple, arima.order_forecast(fits, ["k"]).collect()))


@pytest.mark.parametrize("model", ["RandomForest", "XGBoost"])
def test_configured_searches_draw_from_their_spaces(spark, model):
    estimator, space = regress.configured_search(model, "y")
    grid = regress.random_grid(estimator, space, 20)
    assert len(grid) == 20
    assert all(v in space[p.name] for g in grid for p, v in g.items())
    with pytest.raises(ValueError):
        regress.configured_search("FFNN", "y")


def test_just_below_a_half_is_rounded_down(spark):
    rows = [(0.03 / 600,), (0.49999999999999994e-4,), (0.00005,), (-0.03 / 600,), (2.00005,), (0.00015,)]
    got = spark.createDataFrame(rows, "x double").select(r("x", 4).alias("x")).collect()
    want = [0.0, 0.0, 0.0001, 0.0, 2.0001, 0.0001]
    assert [x["x"] for x in got] == want


def test_rows_are_scored_where_none_can_be_learned_from(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 2.0)], "x double, y double")
    later = spark.createDataFrame([(None,), (3.0,)], "x double")
    for estimator in (regress.linear("y"), regress.linear("y", "lasso"), regress.forest("y", numTrees=2, maxDepth=2), regress.boosting("y", maxIter=2)):
        model = regress.fit(df, ["x"], estimator)
        assert [x["status"] for x in regress.predict(model, df, status=True).collect()] == ["missing features"] * 2
        got = {(x["x"], x["y_pred"], x["status"]) for x in regress.predict(model, later, status=True).collect()}
        assert got == {(None, None, "missing features"), (3.0, None, "no model")}


def test_rounding_is_no_improvement():
    assert regress.best_iteration([1606920.9663406035, 1606920.9663406017]) == 1
    assert regress.best_iteration([4.0, 3.0, 3.0 - 1e-14, 2.9, 2.9]) == 4
    assert regress.best_iteration([float("nan"), 2.0, 0.0, 0.0]) == 3


def test_the_weekly_panel_is_joined_once(spark):
    from tidecast.queries.registry import weekly

    plan = weekly(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
