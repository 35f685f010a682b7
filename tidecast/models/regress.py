"""Distributed regressors on ``pyspark.ml``: linear, forest, boosting, search, importances."""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators.split import row_hash, segments
from tidecast.session import keep

# Mean squared errors closer than this share differ by the rounding of their sums.
ROUNDING = 1e-10

# Model settings of the compared configurations.
FOREST = {"numTrees": 200, "maxDepth": 20, "minInstancesPerNode": 2}
BOOSTING = {"maxIter": 200, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 3}
CATEGORY_BOOSTING = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.05}
FOREST_SEARCH = {
    "numTrees": [100, 200, 300, 500],
    "maxDepth": [10, 20, 30],
    "minInstancesPerNode": [1, 2, 4],
    "featureSubsetStrategy": ["sqrt", "log2", "all"],
}
BOOSTING_SEARCH = {
    "maxIter": [100, 200, 300, 500],
    "stepSize": [0.01, 0.05, 0.1, 0.2],
    "maxDepth": [3, 5, 7, 9],
    "minInstancesPerNode": [1, 3, 5, 7],
    "subsamplingRate": [0.6, 0.7, 0.8, 0.9, 1.0],
    "featureSubsetStrategy": ["0.6", "0.7", "0.8", "0.9", "1.0"],
}


def linear(label: str, regularization: str | None = None, alpha: float = 1.0, train: DataFrame | None = None, intercept: bool = True) -> LinearRegression:
    """Ordinary, ridge or lasso regression with the penalty weight in the usual ``alpha`` scale.

    The normal solver reads the rows once. It divides the ridge penalty by the population deviation
    of the label, so ridge needs the training rows.
    """
    base = LinearRegression(labelCol=label, fitIntercept=intercept, standardization=False)
    if regularization is None:
        return base.setRegParam(0.0)
    if regularization == "ridge":
        s = train.agg(F.stddev_pop(label), F.count(label)).first()
        return base.setElasticNetParam(0.0).setSolver("normal").setRegParam(alpha * s[0] / s[1])
    if regularization == "lasso":
        return base.setElasticNetParam(1.0).setRegParam(alpha)
    raise ValueError(f"unknown regularization {regularization!r}")


def forest(label: str, **settings) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=label, seed=42, featureSubsetStrategy="all").setParams(**{**FOREST, **settings})


def boosting(label: str, **settings) -> GBTRegressor:
    return GBTRegressor(labelCol=label, seed=42, featureSubsetStrategy="0.8").setParams(**{**BOOSTING, **settings})


def category_boosting(label: str, **settings) -> GBTRegressor:
    """Boosting over features that include ordered target statistics of the categories."""
    return GBTRegressor(labelCol=label, seed=42).setParams(**{**CATEGORY_BOOSTING, **settings})


def fit(train: DataFrame, features: list[str], estimator: Estimator) -> PipelineModel:
    """Assemble the features and fit on the complete rows.

    Names in every report come from the assembler, which keeps rows with missing features, so that
    scoring loses none. Without any complete row the model is the assembler alone and predicts nothing.
    """
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    rows = complete(train, [*features, estimator.getLabelCol()])
    try:
        return Pipeline(stages=[assembler, estimator]).fit(rows)
    except Exception:
        # Looked at only after a failure: an unwritten table would be computed once more.
        if not rows.isEmpty():
            raise
        return PipelineModel(stages=[assembler])


def is_fitted(model: PipelineModel) -> bool:
    return len(model.stages) > 1


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null or NaN in ``columns``."""
    return df.dropna(subset=list(dict.fromkeys(columns)))


def predict(model: PipelineModel, df: DataFrame, status: bool = False) -> DataFrame:
    """Every row of ``df`` with ``y_pred``, null where a feature is missing.

    With ``status``, a column says ``scored``, ``missing features`` or, where nothing could be learned, ``no model``.
    """
    whole = F.lit(True)
    for f in model.stages[0].getInputCols():
        value = F.col(f"`{f}`")
        whole = whole & value.isNotNull() & ~F.isnan(value.cast("double"))
    value, known = (F.col("prediction"), "scored") if is_fitted(model) else (F.lit(None).cast("double"), "no model")
    out = model.transform(df).withColumn("y_pred", F.when(whole, value)).drop("prediction", "features")
    return out.withColumn("status", F.when(whole, known).otherwise("missing features")) if status else out


def unscored(predictions: DataFrame) -> int:
    """Rows without a prediction."""
    return predictions.where(F.col("y_pred").isNull()).count()


def importances(model: PipelineModel, top: int | None = None) -> list[tuple[str, float]]:
    """Impurity importance of trees, absolute coefficient of a linear model, largest first."""
    names, fitted = model.stages[0].getInputCols(), model.stages[-1]
    if hasattr(fitted, "featureImportances"):
        weights = fitted.featureImportances.toArray()
    else:
        weights = [abs(c) for c in fitted.coefficients.toArray()]
    ranked = sorted(zip(names, map(float, weights)), key=lambda r: (-r[1], r[0]))
    return ranked[:top]


def split_counts(model: PipelineModel) -> list[tuple[str, int]]:
    """How many nodes of a boosted model split on each feature."""
    names, counts = model.stages[0].getInputCols(), {}
    for line in model.stages[-1].toDebugString.splitlines():
        if "If (feature " in line:
            i = int(line.split("If (feature ")[1].split()[0])
            counts[names[i]] = counts.get(names[i], 0) + 1
    return sorted(((n, counts.get(n, 0)) for n in names), key=lambda r: (-r[1], r[0]))


def coefficients(model: PipelineModel) -> list[tuple[str, float]]:
    """Coefficients and intercept, largest magnitude first."""
    fitted = model.stages[-1]
    rows = list(zip(model.stages[0].getInputCols(), map(float, fitted.coefficients.toArray())))
    rows.append(("intercept", float(fitted.intercept)))
    return sorted(rows, key=lambda r: (-abs(r[1]), r[0]))


def training_history(model: PipelineModel, train: DataFrame, val: DataFrame | None = None) -> list[tuple]:
    """(step, loss, val_loss) of a boosted model, mean squared error after each tree."""
    assembler, fitted = model.stages[0], model.stages[-1]
    needed = [*assembler.getInputCols(), fitted.getLabelCol()]

    def each(rows: DataFrame) -> list[float]:
        return fitted.evaluateEachIteration(assembler.transform(complete(rows, needed)), "squared")

    loss = each(train)
    other = each(val) if val is not None else [None] * len(loss)
    return [(i + 1, float(a), None if b is None else float(b)) for i, (a, b) in enumerate(zip(loss, other))]


def improves(loss: float, best: float) -> bool:
    """Whether a loss is lower by more than rounding."""
    return loss < best and not math.isclose(loss, best, rel_tol=ROUNDING)


def best_iteration(val_loss: list[float], patience: int = 50) -> int:
    """Trees to keep: the best step before ``patience`` steps pass without an improvement.

    A difference in the rounding of the sums, which depends on the order of the rows, is none.
    """
    best, at = float("inf"), 0
    for i, loss in enumerate(val_loss, 1):
        if improves(loss, best):
            best, at = loss, i
        elif i - at >= patience:
            break
    return at


def early_stopping(train: DataFrame, val: DataFrame, features: list[str], estimator: GBTRegressor, patience: int = 50) -> tuple[PipelineModel, int, list[tuple]]:
    """Fit once, score every prefix of trees on the validation rows, keep the best prefix."""
    full = fit(train, features, estimator)
    history = training_history(full, train, val)
    keep = best_iteration([h[2] for h in history], patience)
    return first_trees(full, keep), keep, history


def first_trees(model: PipelineModel, count: int) -> PipelineModel:
    """A boosted model cut to its first ``count`` trees: each tree depends on those before it only."""
    whole = model.stages[-1]
    if count >= whole.getNumTrees:
        return model
    context = SparkSession.getActiveSession().sparkContext
    ml, new_array = context._jvm.org.apache.spark.ml.regression, context._gateway.new_array
    trees, weights = new_array(ml.DecisionTreeRegressionModel, count), new_array(context._jvm.double, count)
    for i in range(count):
        trees[i], weights[i] = whole.trees[i]._java_obj, float(whole.treeWeights[i])
    cut = GBTRegressionModel(ml.GBTRegressionModel(whole.uid, trees, weights, whole.numFeatures))
    cut._resetUid(whole.uid)
    whole._copyValues(cut)
    return PipelineModel(stages=[model.stages[0], cut])


def random_grid(estimator: Estimator, space: dict[str, list], draws: int = 20, seed: int = 42) -> list[dict]:
    """A seeded sample without repetition of the parameter combinations."""
    builder = ParamGridBuilder()
    for name, values in space.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    grid = builder.build()
    return random.Random(seed).sample(grid, min(draws, len(grid)))


def random_search(train: DataFrame, features: list[str], estimator: Estimator, space: dict[str, list], key: list[str], draws: int = 20, folds: int = 5, parallelism: int = 4) -> tuple[PipelineModel, list[tuple[str, float]]]:
    """Cross-validated search by mean squared error. Folds come from the row hash."""
    grid = random_grid(estimator, space, draws)
    fold = F.pmod(F.conv(F.substring(row_hash(key), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    whole = complete(train, [*features, estimator.getLabelCol()])
    rows = keep(assembler.transform(whole.withColumn("_fold", fold)).select("features", estimator.getLabelCol(), "_fold"))
    try:
        search = CrossValidator(
            estimator=estimator,
            estimatorParamMaps=grid,
            evaluator=RegressionEvaluator(labelCol=estimator.getLabelCol(), metricName="mse"),
            numFolds=folds,
            foldCol="_fold",
            parallelism=parallelism,
        ).fit(rows)
    finally:
        rows.unpersist()
    table = [
        (", ".join(f"{p.name}={v}" for p, v in sorted(g.items(), key=lambda kv: kv[0].name)), float(m))
        for g, m in zip(grid, search.avgMetrics)
    ]
    return PipelineModel(stages=[assembler, search.bestModel]), sorted(table, key=lambda r: r[1])


def configured_search(model: str, label: str) -> tuple[Estimator, dict[str, list]]:
    """The estimator and the parameter space of a configured search, for ``random_search``."""
    searches = {"RandomForest": (forest, FOREST_SEARCH), "XGBoost": (boosting, BOOSTING_SEARCH)}
    if model not in searches:
        raise ValueError(f"no search is configured for {model!r}")
    make, space = searches[model]
    return make(label), space


def accuracy_by_size(train: DataFrame, test: DataFrame, time: str, features: list[str], label: str, models: dict[str, Estimator], sizes: list[float], key: list[str]) -> list[tuple[str, float, float]]:
    """RMSE on the same test rows after training on growing prefixes: (model, size, rmse)."""
    rows = train.select(*dict.fromkeys([time, label, *features, *key]))
    n = rows.count()
    sizes = sorted(sizes)
    grown = keep(segments(rows, time, [int(n * s) for s in sizes], key))
    out = []
    try:
        for i, size in enumerate(sizes):
            part = grown.where(F.col("segment") <= i)
            for name, estimator in models.items():
                scored = predict(fit(part, features, estimator), test)
                err = F.col(label) - F.col("y_pred")
                out.append((name, float(size), scored.agg(F.sqrt(F.avg(err * err))).first()[0]))
    finally:
        grown.unpersist()
    return out


def candidate_search(
    tables: dict[str, tuple[DataFrame, DataFrame]], candidates: dict[str, Callable[[str, DataFrame, DataFrame], DataFrame]], label: str
) -> DataFrame:
    """Rank candidates over several tables by the sum of their RMSE ranks: model, rank_sum, best first.

    ``tables`` holds training and test rows by name; a candidate takes the name and both and
    returns the test rows with ``y_pred``. Rows without a prediction are left out of its error.
    """
    from tidecast.operators.windows import rank_models

    scores = []
    for case, (train, test) in tables.items():
        for name, candidate in candidates.items():
            e = F.col(label) - F.col("y_pred")
            scores.append((case, name, candidate(case, train, test).agg(F.sqrt(F.avg(e * e))).first()[0]))
    spark = next(iter(tables.values()))[0].sparkSession
    df = spark.createDataFrame(scores, "case_id string, model string, rmse double")
    return rank_models(df, "rmse").groupBy("model").agg(F.sum("rank").alias("rank_sum")).orderBy("rank_sum", "model")


def score_future(history: DataFrame, future: DataFrame, features: list[str], estimator: Estimator, back: Callable[[Column], Column] | None = None) -> DataFrame:
    """Fit on ``history`` and predict every row of ``future``; ``back`` undoes a transformed label."""
    out = predict(fit(history, features, estimator), future, status=True)
    return out.withColumn("y_pred", back(F.col("y_pred"))) if back else out


def parameters(model: Model) -> list[tuple[str, str]]:
    """Parameter names and values of a fitted stage, as text."""
    return sorted((p.name, str(v)) for p, v in model.extractParamMap().items())


def leakage_ablation(train: DataFrame, test: DataFrame, features: list[str], suspect: str, label: str, estimator: Estimator) -> DataFrame:
    """Test R² without and with a suspect column, and the difference. One row."""
    from tidecast.functions.metrics import r2

    found = []
    for columns in (features, [*features, suspect]):
        scored = predict(fit(train, columns, estimator), test)
        found.append(scored.agg(r2(F.col(label), F.col("y_pred"))).first()[0])
    without, with_suspect = found
    return train.sparkSession.createDataFrame(
        [(without, with_suspect, with_suspect - without)], "r2_without double, r2_with double, gain double"
    )
