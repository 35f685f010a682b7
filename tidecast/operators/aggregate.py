"""Roll-ups, profiles, correlations, histograms, densities and box summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.operators.clean import numeric_columns, string_columns
from tidecast.operators.joins import lookup_join
from tidecast.operators.quantiles import exact_quantiles, fit_quantiles


def rollup(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """One row per key and period. Rows of a hot key combine before the shuffle."""
    return df.groupBy(*keys).agg(*[c.alias(name) for name, c in aggs.items()])


def money_sum(c: str | Column) -> Column:
    """Exact sum of a two-decimal amount, as a double: the same in any row order."""
    col = F.col(c) if isinstance(c, str) else c
    return F.sum(col.cast("decimal(18,2)")).cast("double")


def money_mean(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return money_sum(col) / F.count(col)


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and their share, in one aggregation."""
    missing = sum((F.sum(F.col(f"`{c}`").isNull().cast("long")) for c in df.columns), F.lit(0))
    width = len(df.columns)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(width).cast("long").alias("n_cols"),
        F.coalesce(missing, F.lit(0)).cast("long").alias("missing_total"),
    ).withColumn(
        "missing_pct",
        F.coalesce(F.try_divide(F.col("missing_total") * 100.0, F.col("n_rows") * width), F.lit(0.0)),
    )


def target_profile(df: DataFrame, y: str, by: list[str] = ()) -> DataFrame:
    """Min, max, mean, population deviation, zeros and negatives, with the exact median."""
    by = list(by)
    c = F.col(y)
    stats = df.groupBy(*by).agg(
        F.min(c).cast("double").alias("y_min"),
        F.max(c).cast("double").alias("y_max"),
        F.avg(c).alias("y_mean"),
        F.stddev_pop(c).alias("y_std"),
        F.count_if(c == 0).alias("zeros"),
        F.count_if(c < 0).alias("negatives"),
    )
    median = exact_quantiles(df, y, [0.5], by)
    if by:
        return stats.join(median.select(*by, F.col("q").alias("y_median")), by, "left")
    found = median.first()
    return stats.withColumn("y_median", F.lit(found["q"] if found else None).cast("double"))


def cardinalities(df: DataFrame, top: int = 8) -> DataFrame:
    """Exact distinct counts of the string columns, largest first.

    The cells become (column, value) rows and are grouped twice, so that a hot value is one row
    after the map-side combine.
    """
    cells = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in string_columns(df)]
    )
    return (
        df.select(F.explode(cells).alias("_e"))
        .select("_e.name", "_e.v")
        .where(F.col("v").isNotNull())
        .groupBy("name", "v")
        .agg(F.lit(1).alias("_one"))
        .groupBy("name")
        .agg(F.count("*").alias("n_distinct"))
        .orderBy(F.desc("n_distinct"), "name")
        .limit(top)
    )


def target_correlations(df: DataFrame, y: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Correlation of every numeric column with the target in one pass: name, corr."""
    cols = numeric_columns(df, (y, *exclude))
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(y).cast("double")).alias(c) for c in cols])
    return (
        row.unpivot([], cols, "name", "corr").where(F.col("corr").isNotNull() & ~F.isnan("corr"))
    )


def top_correlations(df: DataFrame, y: str, top: int = 8, exclude: tuple[str, ...] = ()) -> DataFrame:
    return target_correlations(df, y, exclude).orderBy(F.desc(F.abs("corr")), "name").limit(top)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lower triangle in long form: x, y, corr. One pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[: i + 1]]
    row = df.agg(
        *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    )
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("corr"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return row.select(F.explode(cells).alias("_e")).select("_e.x", "_e.y", "_e.corr")


def peak_flag(df: DataFrame, y: str, prob: float = 0.75) -> DataFrame:
    """Flag the rows at or above the exact quantile of ``y``."""
    q = fit_quantiles(df, [y], [prob])[y][prob]
    return df.withColumns(
        {"threshold": F.lit(q), "is_peak": F.coalesce(F.col(y) >= q, F.lit(False)).cast("int")}
    )


def histogram(df: DataFrame, value: str, bins: int, by: list[str] = ()) -> DataFrame:
    """Counts and densities over ``bins`` equal bins from min to max, the last one closed."""
    by = list(by)
    v = F.col(value).cast("double")
    rows = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull())
    span = rows.groupBy(*by).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n")
    )
    if by:
        rows = lookup_join(rows, span, by, "inner", computed=True)
    else:
        s = span.first()
        rows = rows.withColumns(
            {"_lo": F.lit(s["_lo"]), "_hi": F.lit(s["_hi"]), "_n": F.lit(s["_n"])}
        )
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.floor((F.col("_v") - F.col("_lo")) / F.nullif(width, F.lit(0.0)))
    return (
        rows.select(
            *by,
            F.least(F.coalesce(slot, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"),
            F.col("_lo"),
            width.alias("_w"),
            "_n",
        )
        .groupBy(*by, "bin", "_lo", "_w", "_n")
        .agg(F.count("*").alias("n"))
        .select(
            *by,
            "bin",
            (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"),
            "n",
            F.try_divide(F.col("n"), F.col("_n") * F.col("_w")).alias("density"),
        )
    )


def kernel_density(df: DataFrame, value: str, points: int = 50, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on an even grid reaching ``cut`` bandwidths out.

    Every task sums the kernel at all grid points over its rows; only those sums are shuffled.
    """
    v = F.col(value).cast("double")
    s = df.agg(
        F.count(v).alias("n"), F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi")
    ).first()
    if not s["n"] or not s["sd"]:
        raise ValueError("a density needs two different values")
    bw = s["sd"] * s["n"] ** -0.2
    start = s["lo"] - cut * bw
    step = (s["hi"] + cut * bw - start) / (points - 1)
    grid = [start + i * step for i in range(points)]
    weight = s["n"] * bw * math.sqrt(2 * math.pi)
    sums = df.where(v.isNotNull()).agg(*[F.sum(F.exp(-0.5 * ((x - v) / bw) ** 2)).alias(f"s{i}") for i, x in enumerate(grid)])
    rows = [F.struct(F.lit(i).alias("i"), F.lit(x).alias("x"), (F.col(f"s{i}") / weight).alias("density")) for i, x in enumerate(grid)]
    return sums.select(F.inline(F.array(*rows)))


def box_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Quartiles, whiskers at the last points within 1.5 interquartile ranges, outlier count."""
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    quartiles = (
        exact_quantiles(rows, "_v", [0.25, 0.5, 0.75], by)
        .groupBy(*by)
        .agg(
            F.max(F.when(F.col("prob") == 0.25, F.col("q"))).alias("q1"),
            F.max(F.when(F.col("prob") == 0.5, F.col("q"))).alias("median"),
            F.max(F.when(F.col("prob") == 0.75, F.col("q"))).alias("q3"),
        )
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    within = (F.col("_v") >= F.col("q1") - reach) & (F.col("_v") <= F.col("q3") + reach)
    return (
        lookup_join(rows, quartiles, by, "inner", computed=True)
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.min(F.when(within, F.col("_v"))).alias("whisker_low"),
            F.max(F.when(within, F.col("_v"))).alias("whisker_high"),
            F.count_if(~within).alias("outliers"),
        )
    )


def simple_regression(df: DataFrame, y: str, x: str, by: list[str] = ()) -> DataFrame:
    """Least-squares line of y on x; pairs with a gap are ignored."""
    cy, cx = F.col(y).cast("double"), F.col(x).cast("double")
    return df.groupBy(*by).agg(
        F.regr_slope(cy, cx).alias("slope"),
        F.regr_intercept(cy, cx).alias("intercept"),
        F.regr_r2(cy, cx).alias("r2"),
    )


def metric_summary(results: DataFrame, case: str = "case_id") -> DataFrame:
    """Best and mean MAE, RMSE and R² per case, to four decimals."""
    def four(c):
        return F.round(c, 4)

    return results.groupBy(case).agg(
        four(F.min("mae")).alias("mae_min"),
        four(F.avg("mae")).alias("mae_mean"),
        four(F.min("rmse")).alias("rmse_min"),
        four(F.avg("rmse")).alias("rmse_mean"),
        four(F.max("r2")).alias("r2_max"),
        four(F.avg("r2")).alias("r2_mean"),
    )


def metric_pivot(results: DataFrame, metrics: list[str], cases: list[str]) -> DataFrame:
    """Models as rows, one column per (case, metric); the case list avoids a pass to find it."""
    if len(metrics) == 1:
        wide = results.groupBy("model").pivot("case_id", cases).agg(F.avg(metrics[0]))
        return wide.select("model", *[F.col(c).alias(f"{c}_{metrics[0]}") for c in cases])
    return results.groupBy("model").pivot("case_id", cases).agg(*[F.avg(m).alias(m) for m in metrics])


def best_model(results: DataFrame, metric: str = "rmse", by: list[str] = ("case_id",)) -> DataFrame:
    """Model with the best metric per case: smallest error, or largest R²."""
    pick = F.max_by if metric == "r2" else F.min_by
    extreme = F.max if metric == "r2" else F.min
    return results.groupBy(*by).agg(
        pick("model", metric).alias("best_model"), extreme(metric).alias(metric)
    )


def inventory(results: DataFrame, column: str) -> DataFrame:
    return results.select(column).distinct().orderBy(column)
