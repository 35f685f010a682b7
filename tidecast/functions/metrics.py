"""Forecast error measures. Each one is a single aggregate expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidecast.functions.ratios import clip_zero

# Fixed value: targets this close to zero are left out of MAPE.
MAPE_EPSILON = 1e-10


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mape(y: Column, p: Column, epsilon: float = MAPE_EPSILON) -> Column:
    return F.avg(F.when(F.abs(y) > epsilon, F.abs((y - p) / y))) * 100


def r2(y: Column, p: Column) -> Column:
    both = y.isNotNull() & p.isNotNull()
    kept = F.when(both, y)
    spread = F.var_pop(kept) * F.count(kept)
    return 1 - F.try_divide(F.sum((y - p) * (y - p)), F.nullif(spread, F.lit(0.0)))


def rmsle(y: Column, p: Column) -> Column:
    gap = F.log1p(clip_zero(y)) - F.log1p(clip_zero(p))
    return F.sqrt(F.avg(gap * gap))


def all_metrics(y: Column, p: Column, with_rmsle: bool = True) -> list[Column]:
    out = [
        mae(y, p).alias("mae"),
        rmse(y, p).alias("rmse"),
        mape(y, p).alias("mape"),
        r2(y, p).alias("r2"),
    ]
    if with_rmsle:
        out.append(rmsle(y, p).alias("rmsle"))
    return out
