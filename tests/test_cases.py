import math

import pytest
from pyspark.sql import functions as F

from tidecast.plans import cases
from tidecast.schemas import WEEKLY_PANEL
from tidecast.session import fresh_path

MODELS = ["Naive", "SeasonalNaive", "LinearRegression", "XGBoost", "CatBoost"]
FAST = {"XGBoost": {"trees": 4, "depth": 3, "rate": 0.5}, "CatBoost": {"trees": 4, "depth": 3, "rate": 0.5}}


def daily(spark):
    day = F.date_add(F.lit("2015-01-01").cast("date"), F.col("id").cast("int"))
    y = 100 + F.col("id") * 0.5 + F.when(F.weekday(day) < 5, 40).otherwise(0) + F.col("id") % 5
    return spark.range(200).select(day.alias("Date"), y.cast("double").alias("Order_Demand"))


def panel(spark):
    day = F.date_add(F.lit("2022-01-01").cast("date"), (F.col("id") / 4).cast("int"))
    return spark.range(480).select(
        day.alias("Date"), F.concat(F.lit("S"), F.col("id") % 2).alias("Store ID"), F.concat(F.lit("P"), (F.col("id") / 2 % 2).cast("int")).alias("Product ID"),
        F.when(F.col("id") % 2 == 0, "Toys").otherwise("Food").alias("Category"), (20 + F.col("id") % 7).cast("double").alias("Price"),
        F.lit(21.0).alias("Competitor Pricing"), (F.col("id") % 3 * 5.0).alias("Discount"), (100 + F.col("id") % 11).cast("double").alias("Inventory Level"),
        (50 + F.col("id") % 13).cast("double").alias("Units Ordered"), (60 + F.col("id") % 7 * 3 + F.when(F.col("id") % 2 == 0, 20).otherwise(0)).cast("double").alias("Units Sold"),
        F.lit(1.0).alias("Demand Forecast"),
    )


def test_daily_and_panel_cases_end_to_end(spark):
    folder = fresh_path(spark, "report")
    e1, e4 = cases.daily_case(daily(spark), settings=FAST), cases.panel_case(panel(spark), settings=FAST)
    assert "demand_forecast" not in e4.features and "category_toys" in e4.features and e4.categories == ["category"]
    splits = {r["split"]: r["count"] for r in e1.rows.groupBy("split").count().collect()}
    assert set(splits) == {"train", "val", "test"} and splits["test"] == 40
    got = {(r["case_id"], r["model"]): r for r in cases.compare([e1, e4], MODELS, folder, "2020-01-01").collect()}
    assert len(got) == 2 * len(MODELS) and all(r["status"] == "fitted" for r in got.values()), got
    assert got["case1", "LinearRegression"]["rmse"] < got["case1", "Naive"]["rmse"]
    assert got["case4", "CatBoost"]["r2"] > 0.5
    back = spark.read.parquet(f"{folder}/predictions")
    assert back.select("case_id", "model").distinct().count() == 2 * len(MODELS)
    assert back.where("case_id = 'case1' AND model = 'Naive'").count() == splits["test"]
    best = spark.read.option("header", True).csv(f"{folder}/best_models.csv").collect()
    assert {r["case_id"] for r in best} == {"case1", "case4"}
    assert spark.read.json(f"{folder}/summary.json").first()["n_results"] == 2 * len(MODELS)


def weekly(spark):
    week = (F.col("id") / 3).cast("int") + 1
    return spark.range(180).select(
        week.alias("week"), (F.col("id") % 3).cast("int").alias("city_code"), F.lit("x").alias("category"), F.lit("north").alias("Region"),
        (10 + F.col("id") % 4).cast("double").alias("checkout_price"), F.lit(14.0).alias("base_price"), (F.col("id") % 5 == 0).cast("int").alias("emailer_for_promotion"),
        (F.col("id") % 7 == 0).cast("int").alias("homepage_featured"), (200 - 10 * (F.col("id") % 4) + F.col("id") % 3).cast("double").alias("num_orders"),
    )


def test_weekly_case_scores_orders_not_logarithms(spark):
    e = cases.weekly_case(weekly(spark), ranges={"train": (1, 40), "val": (41, 50), "test": (51, 60)})
    got = {r["model"]: r for r in cases.compare([e], ["SeasonalNaive", "LinearRegression"]).collect()}
    assert got["SeasonalNaive"]["n"] == 10 and got["LinearRegression"]["n"] == 30
    assert got["LinearRegression"]["r2"] > 0.8 and 0 < got["LinearRegression"]["mae"] < 10
    assert not math.isnan(got["LinearRegression"]["rmsle"])
    with pytest.raises(ValueError, match="several rows"):
        cases.weekly_case(weekly(spark).unionByName(weekly(spark).limit(1)), WEEKLY_PANEL)


def test_a_model_runs_once_and_statistics_come_from_the_rows_as_they_are(spark, monkeypatch):
    from tidecast.operators import encode
    from tidecast.plans import experiment

    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            calls.add(len(pdf))
            yield pdf

    made = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, None)], "y double, y_pred double")
    monkeypatch.setattr(experiment, "row_predictions", lambda e, model: made.mapInPandas(counted, made.schema))
    rows = spark.createDataFrame([(1, 1, 1.0, "test")], "series_id int, step int, y double, split string")
    e = experiment.Experiment("c", rows, ["series_id"], 7, rows, ["step"], [], "y")
    row = experiment.run(e, ["LinearRegression"]).first()
    assert (row["status"], row["n"], row["n_unscored"], row["mae"]) == ("fitted", 2, 1, 0.5)
    assert calls.value == 3

    # Of several columns a plan holds each join once: what the sums are made from was not joined before.
    read = []
    before = encode._before
    monkeypatch.setattr(encode, "_before", lambda df, *rest: read.append(df.columns) or before(df, *rest))
    df = spark.createDataFrame([(i, "ab"[i % 2], "xyz"[i % 3], float(i)) for i in range(30)], "id long, c string, d string, y double")
    got = encode.permuted_statistics(df, ["c", "d"], "y", ["id"])
    assert read == [df.columns] * 4
    for c in ("c", "d"):
        want = {r["id"]: r[f"{c}_ordered"] for r in encode.permuted_statistic(df, c, "y", ["id"]).collect()}
        assert {r["id"]: r[f"{c}_ordered"] for r in got.collect()} == pytest.approx(want)


def test_the_cross_section_query_runs_the_configured_settings(spark, monkeypatch):
    from tidecast.models import arima, boosting, minibatch, regress
    from tidecast.plans import experiment
    from tidecast.queries import regression

    rows = [(i, 1, 1, 1, "2024-01-01", float(i % 7), float(i % 5)) for i in range(60)]
    made = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey int, l_suppkey int, `order date (DateOrders)` string, `Order Item Total` double, `Days for shipping (real)` double")
    monkeypatch.setattr(regression, "cross_section", lambda spark, sf: made)
    seen, called = [], {}
    monkeypatch.setattr(cases, "run", lambda e, models, *_: seen.append((e, models)) or made.select(F.lit(1.0).alias("mae")))
    regression.cross_section_case(spark, "")
    e, models = seen[0]
    assert models == regression.ALL and len(models) == 11 and e.settings == {}

    class Asked(Exception):
        pass

    def asked(name):
        def run(*a, **conf):
            called[name] = (a, conf)
            raise Asked

        return run

    monkeypatch.setattr(minibatch, "train_minibatches", asked("net"))
    monkeypatch.setattr(boosting, "train_boosted", asked("trees"))
    monkeypatch.setattr(regress, "fit", lambda train, features, estimator: asked("fit")(estimator))
    for model, name, want in (("XGBoost", "trees", boosting.SECOND_ORDER), ("CatBoost", "trees", boosting.SYMMETRIC), ("FFNN", "net", minibatch.DEEP), ("ShallowANN", "net", minibatch.SHALLOW)):
        with pytest.raises(Asked):
            experiment.row_predictions(e, model)
        assert {k: called[name][1][k] for k in want} == want
    with pytest.raises(Asked):
        experiment.row_predictions(e, "RandomForest")
    forest = called["fit"][0][0]
    assert [forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()] == [200, 20, 2]
    monkeypatch.setattr(arima, "fit_orders", lambda *a: asked("orders")(a[5]))
    e.series = spark.createDataFrame([("all", i, float(i % 3), "train" if i < 40 else "test", None if i < 40 else i - 39) for i in range(50)], "series_id string, pos int, y double, split string, step int")
    with pytest.raises(Asked):
        experiment.series_forecast(e, "ARIMAX")
    assert called["orders"][0][0] == arima.search_grid(3, 3)
