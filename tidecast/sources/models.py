"""Saved models, model configurations and training histories as tables."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from tidecast.models.minibatch import NormalisedNetwork
from tidecast.models.network import Network
from tidecast.models.regress import parameters


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_network(spark: SparkSession, net: Network, path: str) -> None:
    """One row per array of weights and per scaled column; the history beside it."""
    rows = [("weights", str(i), list(map(int, w.shape)), w.ravel().tolist()) for i, w in enumerate(net.weights)]
    rows += [("moments", str(i), list(map(int, m.shape)), m.ravel().tolist()) for i, m in enumerate(getattr(net, "moments", []))]
    rows.append(("normalised", "", [1], [float(isinstance(net, NormalisedNetwork))]))
    rows += [("x_scale", c, [2], list(map(float, net.x_scale[c]))) for c in net.features]
    rows.append(("y_scale", "", [2], list(map(float, net.y_scale))))
    rows.append(("best_epoch", "", [1], [float(net.best_epoch)]))
    rows += [("history", str(i), [3], [float(h[0]), h[1], h[2]]) for i, h in enumerate(net.history)]
    schema = "part string, name string, shape array<int>, numbers array<double>"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_network(spark: SparkSession, path: str) -> Network:
    found: dict[str, list] = {}
    for row in spark.read.parquet(path).collect():
        found.setdefault(row["part"], []).append(row)
    arrays, moments = (sorted(found.get(part, []), key=lambda r: int(r["name"])) for part in ("weights", "moments"))
    normalised = "normalised" in found and found["normalised"][0]["numbers"][0] == 1
    history = sorted(found.get("history", []), key=lambda r: int(r["name"]))
    kind, extra = (NormalisedNetwork, {"moments": [np.array(r["numbers"]).reshape(r["shape"]) for r in moments]}) if normalised else (Network, {})
    return kind(
        features=[r["name"] for r in found["x_scale"]],
        weights=[np.array(r["numbers"]).reshape(r["shape"]) for r in arrays],
        x_scale={r["name"]: tuple(r["numbers"]) for r in found["x_scale"]},
        y_scale=tuple(found["y_scale"][0]["numbers"]),
        history=[(int(r["numbers"][0]), r["numbers"][1], r["numbers"][2]) for r in history],
        best_epoch=int(found["best_epoch"][0]["numbers"][0]),
        **extra,
    )


def save_states(states: DataFrame, path: str) -> None:
    """Fitted series models, one row per series: smoothing states or ARMA fits with their paths."""
    states.write.mode("overwrite").parquet(path)


def load_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def training_histories(spark: SparkSession, histories: dict[tuple[str, str], list[tuple]]) -> DataFrame:
    """(case_id, model, step, loss, val_loss, best): losses by tree or epoch; ``best`` marks the lowest watched loss."""
    rows = []
    for (case, name), history in histories.items():
        watched = [loss if val is None else val for _, loss, val in history]
        best = watched.index(min(watched)) if watched else -1
        rows += [(case, name, int(step), float(loss), val, i == best) for i, (step, loss, val) in enumerate(history)]
    return spark.createDataFrame(rows, "case_id string, model string, step int, loss double, val_loss double, best boolean")


def model_configurations(spark: SparkSession, models: dict[tuple[str, str], PipelineModel | Network]) -> DataFrame:
    """(case_id, model, parameter, value) with values as text, and the number of features."""
    rows = []
    for (case, name), model in models.items():
        if isinstance(model, Network):
            layers = model.hidden
            rows += [(case, name, "n_features", str(len(model.features))), (case, name, "hidden", str(layers)), (case, name, "best_epoch", str(model.best_epoch))]
            continue
        rows.append((case, name, "n_features", str(len(model.stages[0].getInputCols()))))
        rows += [(case, name, p, v) for p, v in parameters(model.stages[-1])]
    return spark.createDataFrame(rows, "case_id string, model string, parameter string, value string")
