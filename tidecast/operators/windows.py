"""Lags, rolling statistics, differences, decomposition and ranks.

All windows of one series share the same partitioning and order, so a feature table costs one
shuffle and one sort. Input: one row per (keys, time), see ``aggregate.rollup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec


def series(keys: list[str], time: str) -> WindowSpec:
    if not keys:
        raise ValueError("a window needs series keys: a window over a whole table is one task")
    return W.partitionBy(*keys).orderBy(time)


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Raise when two rows share a key, otherwise return ``df``."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several rows for {twice[0].asDict()}; roll up to one row per {keys}")
    return df


def lag_columns(y: str, lags: list[int], w: WindowSpec) -> dict[str, Column]:
    return {f"lag_{k}": F.lag(y, k).over(w) for k in lags}


def rolling_columns(y: str, widths: list[int], w: WindowSpec) -> dict[str, Column]:
    """Mean and sample deviation of the preceding rows; the current row is never in the frame."""
    out: dict[str, Column] = {}
    for n in widths:
        frame = w.rowsBetween(-n, -1)
        out[f"rolling_mean_{n}"] = F.avg(y).over(frame)
        out[f"rolling_std_{n}"] = F.stddev_samp(y).over(frame)
    return out


def change_columns(c: str, w: WindowSpec, name: str = "price_change") -> dict[str, Column]:
    """Difference to the previous row, a flag for a rise, and the relative change (0 if unknown)."""
    before = F.lag(c, 1).over(w)
    diff = F.col(c) - before
    return {
        name: diff,
        f"{name}_yn": F.coalesce(diff > 0, F.lit(False)).cast("int"),
        f"{name}_pct": F.coalesce(F.try_divide(diff, before), F.lit(0.0)),
    }


def calendar_fill(df: DataFrame, keys: list[str], time: str, unit: str = "day") -> DataFrame:
    """Add the missing periods of each series with a null target, so that a lag is a calendar lag.

    Each series grows at most to the length of its own calendar.
    """
    step = F.expr(f"interval 1 {unit}")
    span = df.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    days = span.select(*keys, F.explode(F.sequence("_a", "_b", step)).alias(time))
    return days.join(df, [*keys, time], "left")


def time_index(df: DataFrame, time: str, name: str = "time_index") -> DataFrame:
    """Days since the earliest date of the table."""
    first = df.agg(F.min(F.to_date(time))).first()[0]
    return df.withColumn(name, F.datediff(F.to_date(time), F.lit(first)))


def difference(df: DataFrame, y: str, keys: list[str], time: str, order: int = 1, season: int = 0) -> DataFrame:
    """``order`` ordinary differences, then one seasonal difference when ``season`` is given.

    Repeated differences are one linear combination of lags, so a single window serves any order.
    """
    weights = {0: 1}
    for gap in [1] * order + ([season] if season else []):
        shifted: dict[int, int] = {}
        for lag, a in weights.items():
            shifted[lag] = shifted.get(lag, 0) + a
            shifted[lag + gap] = shifted.get(lag + gap, 0) - a
        weights = shifted
    w = series(keys, time)
    total: Column | None = None
    for lag, a in sorted(weights.items()):
        if a:
            term = a * (F.col(y) if lag == 0 else F.lag(y, lag).over(w))
            total = term if total is None else total + term
    return df.withColumn("diff", total)


def decompose(df: DataFrame, y: str, keys: list[str], time: str, period: int) -> DataFrame:
    """Additive split into trend, seasonal and residual parts.

    Trend: centred moving average over one period, with half weights at both ends when the period
    is even, null where the frame is incomplete. Seasonal: mean detrended value per phase, centred.
    """
    w = series(keys, time)
    half = period // 2
    frame = w.rowsBetween(-half, half)
    width = 2 * half + 1
    whole = F.count(y).over(frame) == width
    total = F.sum(F.col(y).cast("double")).over(frame)
    if period % 2 == 0:
        total = total - 0.5 * (F.lag(y, half).over(w) + F.lead(y, half).over(w))
    base = df.select(
        "*",
        (F.row_number().over(w) - 1).alias("_pos"),
        F.when(whole, total / period).alias("trend"),
    ).withColumn("_phase", F.pmod(F.col("_pos"), F.lit(period)))
    by_phase = W.partitionBy(*keys, "_phase")
    raw = base.withColumn("_raw", F.avg(F.col(y) - F.col("trend")).over(by_phase))
    level = F.avg(F.when(F.col("_pos") < period, F.col("_raw"))).over(W.partitionBy(*keys))
    return (
        raw.withColumn("seasonal", F.col("_raw") - level)
        .withColumn("residual", F.col(y) - F.col("trend") - F.col("seasonal"))
        .drop("_pos", "_phase", "_raw")
    )


def rank_models(results: DataFrame, metric: str, case: str = "case_id") -> DataFrame:
    """Rank within each case; ties share the smaller rank. R² ranks from the top."""
    order = F.desc(metric) if metric == "r2" else F.asc(metric)
    return results.withColumn(
        "rank", F.rank().over(W.partitionBy(case).orderBy(order)).cast("int")
    )


def average_rank(results: DataFrame, metric: str, case: str = "case_id") -> DataFrame:
    return (
        rank_models(results, metric, case)
        .groupBy("model")
        .agg(F.avg("rank").alias("mean_rank"))
        .orderBy("mean_rank", "model")
    )


def naive_residuals(df: DataFrame, y: str, keys: list[str], time: str) -> DataFrame:
    """In-sample one-step errors of the last-value forecast."""
    w = series(keys, time)
    return df.withColumn("fitted", F.lag(y, 1).over(w)).withColumn(
        "residual", F.col(y) - F.col("fitted")
    )
