"""Scores, comparisons, relative errors and leakage checks over long prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.metrics import all_metrics
from tidecast.operators.aggregate import peak_flag, rollup, target_correlations
from tidecast.operators.joins import align, with_benchmark

LEAK_CORRELATION = 0.95


def score(
    predictions: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred", with_rmsle: bool = True
) -> DataFrame:
    """All error measures per group in one aggregation; rows without a prediction are left out."""
    pairs = predictions.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    return pairs.groupBy(*by).agg(*all_metrics(F.col(y), F.col(p), with_rmsle), F.count("*").alias("n"))


def compare_models(results: DataFrame, case: str | None = None, split: str | None = "test") -> DataFrame:
    if case is not None:
        results = results.where(F.col("case_id") == case)
    if split is not None:
        results = results.where(F.col("split") == split)
    return results.orderBy("rmse", "model")


def relative_mae(results: DataFrame, benchmark: str = "Naive") -> DataFrame:
    """MAE over the benchmark's MAE of the same case: 1 for the benchmark by construction."""
    joined = with_benchmark(results, "case_id", "model", "mae", benchmark)
    return joined.withColumn("rmae", F.try_divide("mae", f"mae_{benchmark}"))


def errors(predictions: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    e = F.col(y) - F.col(p)
    return predictions.withColumns({"error": e, "abs_error": F.abs(e)})


def period_totals(predictions: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Row predictions summed to one total per period."""
    return rollup(predictions, by, y_true=F.sum(y), y_pred=F.sum(p))


def peak_comparison(actual: DataFrame, predicted: DataFrame, time: str, y: str, prob: float = 0.75) -> DataFrame:
    """Actual against predicted totals in the periods at or above the quantile."""
    peaks = peak_flag(actual, y, prob).where("is_peak = 1")
    return align(peaks, predicted, [time])


def deny_list_violations(df: DataFrame, deny: list[str]) -> list[str]:
    return [c for c in deny if c in df.columns]


def leakage_flags(df: DataFrame, y: str, deny: list[str], limit: float = LEAK_CORRELATION) -> DataFrame:
    """Known outcome columns that are present, and numeric columns that nearly equal the target."""
    found = deny_list_violations(df, deny)
    schema = T.StructType(
        [T.StructField("name", T.StringType()), T.StructField("reason", T.StringType())]
    )
    listed = df.sparkSession.createDataFrame([(c, "outcome column") for c in found], schema)
    close = target_correlations(df, y).where(F.abs("corr") > limit)
    return listed.unionByName(close.select("name", F.lit("correlation").alias("reason")))
