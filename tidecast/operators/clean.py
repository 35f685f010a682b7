"""Imputation, winsorising, scaling, encoding, narrowing. Statistics come from ``fit_*``.

Every ``fit_*`` takes the rows to learn from, so the caller decides whether those are the training
rows (the default in the pipelines) or the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidecast.operators.joins import lookup_with_default
from tidecast.operators.quantiles import fit_quantiles

UNKNOWN = "Unknown"
# Winsorising percentiles.
WINSOR_LOWER, WINSOR_UPPER = 0.01, 0.99
# One-hot encoding makes one column per category; by default a wider column set is an error.
MAX_ONE_HOT = 2_000


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def string_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in exclude
    ]


def fit_imputer(df: DataFrame, columns: list[str], strategy: str = "median") -> dict[str, float]:
    """Fill value per numeric column: its median, its mean, or 0."""
    if strategy == "median":
        return {c: q[0.5] for c, q in fit_quantiles(df, columns, [0.5]).items()}
    if strategy == "mean":
        row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
        return {c: row[c] for c in columns if row[c] is not None}
    if strategy == "zero":
        return {c: 0.0 for c in columns}
    raise ValueError(f"unknown strategy {strategy!r}")


def apply_imputer(df: DataFrame, fill: dict[str, float]) -> DataFrame:
    """Fill numeric gaps. Integer columns become double so that a fractional fill stays whole."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fill.items()})


def fill_unknown(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.fillna(UNKNOWN, subset=columns if columns is not None else string_columns(df))


def fit_winsor(
    df: DataFrame, columns: list[str], lower: float = WINSOR_LOWER, upper: float = WINSOR_UPPER
) -> dict[str, tuple[float, float]]:
    return {
        c: (q[lower], q[upper]) for c, q in fit_quantiles(df, columns, [lower, upper]).items()
    }


def apply_winsor(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    def clip(c, lo, hi):
        v = F.col(c).cast("double")
        return F.when(v < lo, F.lit(lo)).when(v > hi, F.lit(hi)).otherwise(v)

    return df.withColumns({c: clip(c, lo, hi) for c, (lo, hi) in bounds.items()})


def fit_scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation in one aggregation; zero spread scales by 1."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)],
    ).first()
    return {
        c: (row[f"m_{i}"] or 0.0, row[f"s_{i}"] or 1.0) for i, c in enumerate(columns)
    }


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns(
        {c: (F.col(c).cast("double") - m) / s for c, (m, s) in scaler.items() if c in df.columns}
    )


def fit_target_encoding(
    df: DataFrame, column: str, target: str, overall: float | None = None
) -> tuple[DataFrame, float]:
    """Mean target per category, and the overall mean for categories never seen."""
    mean = F.avg(f"`{target}`")
    mapping = (
        df.where(F.col(f"`{column}`").isNotNull()).groupBy(f"`{column}`").agg(mean.alias(f"{column}_encoded"))
    )
    return mapping, df.agg(mean).first()[0] if overall is None else overall


def apply_target_encoding(df: DataFrame, column: str, fitted: tuple[DataFrame, float]) -> DataFrame:
    mapping, overall = fitted
    return lookup_with_default(df, mapping, column, f"{column}_encoded", overall, computed=True).drop(column)


def fit_one_hot(df: DataFrame, columns: list[str], drop_first: bool = True, most: int = MAX_ONE_HOT) -> dict[str, list]:
    """Sorted categories per column, the first one left out as the base level.

    One job for all columns. More than ``most`` categories in a column are an error.
    """
    if not columns:
        return {}
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)])).alias("p"))
    seen = pairs.select("p.*").where("v IS NOT NULL").distinct()
    ranked = seen.withColumn("k", F.row_number().over(W.partitionBy("i").orderBy("v"))).where(F.col("k") <= most + 1)
    found: dict[int, list] = {}
    for r in ranked.select("i", F.col("v")).collect():
        found.setdefault(r["i"], []).append(r["v"])
    out = {}
    for i, c in enumerate(columns):
        values = found.get(i, [])
        if len(values) > most:
            raise ValueError(f"{c} has over {most} categories; use target encoding")
        kind = df.schema[c].dataType
        if isinstance(kind, T.IntegralType):
            values = [int(v) for v in values]
        elif not isinstance(kind, T.StringType):
            values = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect()]
        out[c] = sorted(values)[1:] if drop_first else sorted(values)
    return out


def apply_one_hot(df: DataFrame, categories: dict[str, list]) -> DataFrame:
    """0/1 columns named ``column_value``. Unseen or missing categories are all zeros."""
    flags = [
        F.coalesce(F.col(c) == v, F.lit(False)).cast("int").alias(f"{c}_{v}")
        for c, values in categories.items()
        for v in values
    ]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in categories], *flags)


def common_columns(*frames: DataFrame) -> list[str]:
    """Sorted columns present in every frame."""
    shared = set(frames[0].columns)
    for frame in frames[1:]:
        shared &= set(frame.columns)
    return sorted(shared)


def native_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """Categories as strings, for a model that encodes them itself."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


# Limits of the narrow integer types.
INTEGER_TYPES = (("tinyint", -128, 127), ("smallint", -32768, 32767), ("int", -2147483648, 2147483647))
FLOAT_LIMIT = 3.4028234663852886e38


def narrow_types(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Cast each numeric column to the smallest type that strictly contains its values."""
    cols = numeric_columns(df)
    row = df.agg(
        *[F.min(c).alias(f"lo_{i}") for i, c in enumerate(cols)],
        *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(cols)],
    ).first()
    chosen: dict[str, str] = {}
    for i, c in enumerate(cols):
        lo, hi = row[f"lo_{i}"], row[f"hi_{i}"]
        if lo is None:
            continue
        if isinstance(df.schema[c].dataType, T.IntegralType):
            fits = [name for name, low, high in INTEGER_TYPES if low < lo and hi < high]
            chosen[c] = fits[0] if fits else "bigint"
        elif -FLOAT_LIMIT < lo and hi < FLOAT_LIMIT:
            chosen[c] = "float"
    return df.withColumns({c: F.col(c).cast(t) for c, t in chosen.items()}), chosen
