import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.models import network, regress
from tidecast.operators import evaluate as ev
from tidecast.plans import experiment
from tidecast.sources import models as saved


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 2))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 5 + rng.normal(0, 0.1, 600)
    data = [(i, float(a), float(b), float(c), "val" if i % 5 == 0 else "test" if i % 5 == 1 else "train", f"g{i % 3}") for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id int, a double, b double, y double, split string, g string").repartition(6).persist()


def test_linear_variants_match_closed_form(rows):
    data = rows.select("a", "b", "y").toPandas()
    x, y = data[["a", "b"]].to_numpy(), data["y"].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    ols = regress.fit(rows, ["a", "b"], regress.linear("y")).stages[-1]
    np.testing.assert_allclose(ols.coefficients.toArray(), np.linalg.solve(xc.T @ xc, xc.T @ yc), rtol=1e-6)
    ridge = regress.fit(rows, ["a", "b"], regress.linear("y", "ridge", 200.0, rows)).stages[-1]
    np.testing.assert_allclose(ridge.coefficients.toArray(), np.linalg.solve(xc.T @ xc + 200 * np.eye(2), xc.T @ yc), rtol=1e-5)
    lasso = regress.fit(rows, ["a", "b"], regress.linear("y", "lasso", 2.5)).stages[-1]
    assert lasso.coefficients[1] == pytest.approx(0, abs=1e-6) and 0 < lasso.coefficients[0] < 1


def test_reports_use_feature_names(rows):
    model = regress.fit(rows, ["a", "b"], regress.linear("y"))
    assert [n for n, _ in regress.coefficients(model)] == ["intercept", "a", "b"]
    assert regress.importances(model, 1)[0][0] == "a"
    trees = regress.fit(rows, ["a", "b"], regress.boosting("y", maxIter=3, maxDepth=3))
    counts = dict(regress.split_counts(trees))
    assert set(counts) == {"a", "b"} and counts["a"] > 0
    assert sum(v for _, v in regress.importances(trees)) == pytest.approx(1)


def test_early_stopping_keeps_the_best_prefix(rows):
    assert regress.best_iteration([5, 3, 4, 4, 1], patience=2) == 2
    assert regress.best_iteration([5, 3, 4, 4, 1], patience=5) == 5
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    model, keep, history = regress.early_stopping(train, val, ["a", "b"], regress.boosting("y", maxIter=4, maxDepth=2, stepSize=0.5), 2)
    assert model.stages[-1].getNumTrees == keep and len(history) == 4
    again = regress.training_history(model, train, val)
    assert again[-1][2] == pytest.approx(history[keep - 1][2])


def test_search_and_sizes(rows):
    model, table = regress.random_search(rows, ["a", "b"], regress.forest("y"), {"numTrees": [2], "maxDepth": [1, 5]}, ["id"], draws=2, folds=2)
    assert table[0][0].startswith("maxDepth=5") and model.stages[-1].getNumTrees == 2
    dated = rows.withColumn("t", F.date_add(F.lit("2020-01-01").cast("date"), F.col("id")))
    out = regress.accuracy_by_size(dated, dated, "t", ["a", "b"], "y", {"lin": regress.linear("y")}, [0.5, 1.0], ["id"])
    assert [(m, s) for m, s, _ in out] == [("lin", 0.5), ("lin", 1.0)] and out[1][2] < 0.2


def test_saved_model_scores_the_same(rows, tmp_path):
    model = regress.fit(rows, ["a", "b"], regress.forest("y", numTrees=3, maxDepth=3))
    saved.save_model(model, str(tmp_path / "m"))
    a = regress.predict(model, rows).orderBy("id").collect()
    b = regress.predict(saved.load_model(str(tmp_path / "m")), rows).orderBy("id").collect()
    assert a == b
    table = saved.model_configurations(rows.sparkSession, {("case1", "RF"): model})
    assert table.where("parameter = 'n_features'").first()["value"] == "2"


def test_ablation_shows_the_leak(rows):
    leaky = rows.withColumn("leak", F.col("y"))
    got = regress.leakage_ablation(leaky, leaky, ["b"], "leak", "y", regress.linear("y")).first()
    assert got["r2_with"] == pytest.approx(1) and got["gain"] > 0.3


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(9, 3)), rng.normal(size=9)
    w = network.start_weights([3, 4, 2, 1], 1)
    grads, loss = network.gradient(x, y, w)
    for i in range(len(w)):
        at = tuple(0 for _ in w[i].shape)
        moved = [v.copy() for v in w]
        moved[i][at] += 1e-6
        assert (network.gradient(x, y, moved)[1] - loss) / 1e-6 == pytest.approx(grads[i][at], rel=1e-3, abs=1e-4)


@pytest.mark.parametrize("fan_in", [2, 32])
def test_network_learns_and_ignores_partitioning(rows, fan_in):
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    conf = dict(hidden=(16,), learning_rate=0.05, epochs=40, patience=40, val=val, fan_in=fan_in)
    net = network.train_network(train, ["a", "b"], "y", **conf)
    assert net.history[-1][2] < net.history[0][2] / 10
    out = network.network_predict(net, rows.where("split = 'test'"))
    e = F.col("y") - F.col("y_pred")
    assert out.agg(F.sqrt(F.avg(e * e))).first()[0] < 1.0
    other = network.train_network(train.repartition(2), ["a", "b"], "y", **{**conf, "epochs": 3})
    np.testing.assert_allclose([h[1] for h in other.history], [h[1] for h in net.history[:3]], rtol=1e-9)
    missing = rows.limit(1).withColumn("a", F.lit(None).cast("double"))
    assert network.network_predict(net, missing).first()["y_pred"] is None


def test_metrics_edges(spark):
    def one(pairs):
        df = spark.createDataFrame([("m", a, b) for a, b in pairs], "model string, y_true double, y_pred double")
        return ev.score(df, ["model"]).first()

    zero = one([(0.0, 1.0), (0.0, 2.0)])
    assert zero["mape"] is None and zero["r2"] is None and zero["mae"] == 1.5
    perfect = one([(1.0, 1.0), (2.0, 2.0)])
    assert (perfect["r2"], perfect["rmse"], perfect["mape"]) == (1.0, 0.0, 0.0)
    below = one([(1.0, -5.0), (3.0, 3.0)])
    assert below["rmsle"] == pytest.approx(np.sqrt(np.log(2) ** 2 / 2))
    y, p = np.array([3.0, -1.0, 7.0]), np.array([2.0, 0.0, 9.0])
    got = one(list(zip(y.tolist(), p.tolist())))
    assert got["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_relative_mae_of_the_benchmark_is_one(spark):
    df = spark.createDataFrame([("c", "Naive", 4.0), ("c", "X", 1.0)], "case_id string, model string, mae double")
    assert {r["model"]: r["rmae"] for r in ev.relative_mae(df).collect()} == {"Naive": 1.0, "X": 0.25}


def test_leakage_flags(spark):
    df = spark.createDataFrame([(float(i), float(i * 2), float(i % 3), "x") for i in range(50)], "y double, twin double, other double, bad string")
    got = {(r["name"], r["reason"]) for r in ev.leakage_flags(df, "y", ["bad", "absent"]).collect()}
    assert got == {("bad", "outcome column"), ("twin", "correlation")}


def test_experiment_scores_models_and_records_failures(spark, rows):
    pos = spark.range(60).select(F.lit("s").alias("k"), F.col("id").cast("int").alias("pos"), (F.col("id") * 1.0 + F.col("id") % 4).alias("y"))
    parts = pos.select("*", F.when(F.col("pos") < 48, "train").otherwise("test").alias("split"), F.when(F.col("pos") >= 48, F.col("pos") - 47).alias("step"))
    e = experiment.Experiment("demo", parts, ["k"], 4, rows, ["id"], ["a", "b"], "y", ["g"], settings={
        "CatBoost": {"trees": 3, "depth": 3}, "XGBoost": {"trees": 4, "depth": 3, "rate": 0.5, "patience": 2},
        "ARIMAX": {"most_p": 1, "most_q": 1}, "ShallowANN": {"epochs": 2, "hidden": (4,)},
    })
    models = ["Naive", "SeasonalNaive", "ETS", "ARIMAX", "SARIMAX", "LinearRegression", "XGBoost", "CatBoost", "ShallowANN", "Nothing"]
    got = {r["model"]: r for r in experiment.run(e, models).collect()}
    assert set(got) == set(models)
    assert got["Nothing"]["status"] == "failed" and "unknown model" in got["Nothing"]["message"]
    assert all(got[m]["status"] == "fitted" for m in models[:-1]), {m: got[m]["message"] for m in models}
    assert got["LinearRegression"]["r2"] > 0.99 and got["ETS"]["mae"] < got["Naive"]["mae"]
