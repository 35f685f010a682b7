"""Horizon rows, tagged unions, wide-to-long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.operators.joins import union_all


def append_horizon(train: DataFrame, future: DataFrame, time: str, target: str) -> DataFrame:
    """Add future rows with a missing target, so lags carry over the boundary.

    Only periods after the last training period are accepted: anything else would put missing
    values inside the lag frames.
    """
    last = train.agg(F.max(time)).first()[0]
    early = future.where(F.col(time) <= F.lit(last)).limit(1).count()
    if early:
        raise ValueError(f"future rows must lie after {last}")
    blank = future.withColumn(target, F.lit(None).cast(train.schema[target].dataType))
    return train.unionByName(blank, allowMissingColumns=True)


def tagged_union(frames: dict[str, DataFrame], tag: str = "case_id") -> DataFrame:
    return union_all([df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


def to_long(df: DataFrame, ids: list[str], values: list[str], name: str = "model") -> DataFrame:
    return df.unpivot(ids, values, name, "value")


def ordered_columns(df: DataFrame, preferred: list[str]) -> DataFrame:
    """Preferred columns first, the rest in their own order."""
    first = [c for c in preferred if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])
