"""Naive, seasonal naive and exponential smoothing forecasts over many series.

Input: one row per (keys, time). A series is then as long as its calendar at most, which is what
lets one task hold it as an array; ``MAX_POINTS`` makes the assumption an error instead of a crash.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidecast.models import simplex
from tidecast.session import task_count

MAX_POINTS = 200_000


def last_value_forecast(df: DataFrame, keys: list[str], time: str, y: str, horizon: int) -> DataFrame:
    """The last value of each series, repeated: keys, step, y_pred."""
    last = df.groupBy(*keys).agg(F.max_by(y, time).alias("y_pred"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    return last.select(*keys, steps, F.col("y_pred").cast("double").alias("y_pred"))


def seasonal_forecast(
    df: DataFrame, keys: list[str], time: str, y: str, season: int, horizon: int
) -> DataFrame:
    """The last ``season`` values of each series, tiled. A shorter series tiles what it has."""
    w = W.partitionBy(*keys).orderBy(F.desc(time))
    tail = df.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= season)
    packed = tail.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(time, F.col(y).cast("double").alias("v")))).alias("_a")
    )
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    at = F.pmod(F.col("step") - 1, F.size("_a"))
    return packed.select(*keys, "_a", steps).select(
        *keys, "step", F.col("_a")[at]["v"].alias("y_pred")
    )


def series_arrays(df: DataFrame, keys: list[str], time: str, y: str) -> DataFrame:
    """One ordered array ``ys`` per series."""
    pairs = F.array_sort(F.collect_list(F.struct(time, F.col(y).cast("double").alias("v"))))
    packed = df.where(F.col(y).isNotNull()).groupBy(*keys).agg(F.transform(pairs, lambda r: r["v"]).alias("ys"))
    too_long = F.raise_error(F.lit(f"a series has over {MAX_POINTS} periods; roll up to a coarser period"))
    return packed.withColumn(
        "ys", F.when(F.size("ys") <= MAX_POINTS, F.col("ys")).otherwise(too_long.cast("array<double>"))
    )


# Smoothing weights tried for each component.
ALPHAS = (0.1, 0.3, 0.5, 0.7, 0.9)
BETAS = (0.05, 0.15, 0.4)
GAMMAS = (0.05, 0.2, 0.5)
PHIS = (0.9, 0.98)

CANDIDATE_SCHEMA = T.StructType(
    [
        T.StructField("trend", T.StringType()),
        T.StructField("seasonal", T.StringType()),
        T.StructField("damped", T.BooleanType()),
        T.StructField("season", T.IntegerType()),
        T.StructField("alpha", T.DoubleType()),
        T.StructField("beta", T.DoubleType()),
        T.StructField("gamma", T.DoubleType()),
        T.StructField("phi", T.DoubleType()),
    ]
)


def smoothing_grid(
    trend: str | None,
    seasonal: str | None,
    damped: bool,
    season: int,
    alphas=ALPHAS,
    betas=BETAS,
    gammas=GAMMAS,
    phis=PHIS,
) -> list[tuple]:
    """Parameter rows of one smoothing variant. Unused weights take their neutral value."""
    return [
        (trend or "none", seasonal or "none", damped, season if seasonal else 1, a, b, g, p)
        for a, b, g, p in itertools.product(
            alphas,
            betas if trend else (0.0,),
            gammas if seasonal else (0.0,),
            phis if damped else (1.0,),
        )
    ]


def all_variants(season: int | None) -> list[tuple]:
    """Additive trend and season, each on or off; damping only with a trend."""
    rows: list[tuple] = []
    for trend in ("add", None):
        for seasonal in ("add", None) if season else (None,):
            for damped in (True, False) if trend else (False,):
                rows += smoothing_grid(trend, seasonal, damped, season or 1)
    return rows


def _array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def smooth(arrays: DataFrame, keys: list[str], candidates: list[tuple], search: bool = False) -> DataFrame:
    """Run every candidate over every series: final state, squared error, AIC, status.

    With ``search``, the candidates of one variant (trend, season, damping) are the starts of a
    search for its continuous weights, and every variant gives one row.

    Errors count from the longest season among the candidates that fit the series, so that all of
    them are compared on the same observations. A series too short for every candidate gets one
    row with status ``fallback`` that repeats its last value.
    One fold per (series, candidate) inside the SQL engine, carrying level, trend and the season
    as a rotating queue. Candidates become rows. They are spread over tasks when there are fewer
    series than partitions, and stay beside their series otherwise so that arrays are not copied
    through a shuffle.
    """
    spark = arrays.sparkSession
    parts = task_count(spark)
    any_mul = any("mul" in (c[0], c[1]) for c in candidates)
    fields = [f.name for f in CANDIDATE_SCHEMA]
    heads, tails = fields[:4], fields[4:]
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(c, fields)]) for c in candidates]
    if search:
        # Errors can have several minima: a search from each level weight and trend weight (without a
        # trend, season weight).
        variants: dict[tuple, dict] = {}
        for c in candidates:
            variants.setdefault(c[:4], {}).setdefault((c[4], c[5] if c[0] != "none" else c[6]), []).append(c[4:])
        structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(head, heads)]) for head in variants]
    grid = F.array(*structs)
    few = arrays.select(*keys).limit(parts + 1).count() <= parts
    if few:
        cand = F.posexplode(grid).alias("_cid", "_c")
        rows = arrays.select(*keys, "ys", cand).repartition(parts, *keys, "_cid")
    else:
        rows = arrays.repartition(parts, *keys).select(*keys, "ys", F.posexplode(grid).alias("_cid", "_c"))
    rows = rows.select(*keys, "_cid", *[F.col(f"_c.{n}").alias(n) for n in (heads if search else fields)], "ys")

    # Multiplicative parts need positive values: shift, and shift the forecast back.
    mul_season, mul_trend = F.col("seasonal") == "mul", F.col("trend") == "mul"
    low = F.array_min("ys")
    shift = F.when((mul_season | mul_trend) & (low <= 0), 1 - low).otherwise(0.0) if any_mul else F.lit(0.0)
    rows = rows.withColumn("shift", shift)
    if any_mul:
        rows = rows.withColumn("ys", F.transform("ys", lambda v: v + F.col("shift")))
    needed = {(c[3] if c[1] != "none" else 1): (2 * c[3] if c[1] != "none" else 3) for c in candidates}
    rows = rows.withColumn("n", F.size("ys")).where(
        F.col("n") >= F.when(F.col("seasonal") == "none", 3).otherwise(2 * F.col("season"))
    )
    common = F.greatest(F.lit(0), F.lit(0), *[F.when(F.col("n") >= least, F.lit(skip)).otherwise(0) for skip, least in needed.items()])
    rows = rows.withColumn("_from", common)
    s = F.col("season")
    first, second = F.slice("ys", F.lit(1), s), F.slice("ys", s + 1, s)
    rows = rows.withColumns({"_m1": _array_mean(first), "_m2": _array_mean(second)})
    slope = (F.col("_m2") - F.col("_m1")) / s
    b0 = F.when(F.col("trend") == "add", slope).otherwise(0.0)
    q0 = F.transform(first, lambda v: v - F.col("_m1"))
    if any_mul:
        ratio = F.pow(F.try_divide("_m2", "_m1"), 1.0 / s)
        b0 = F.when(mul_trend, ratio).otherwise(b0)
        q0 = F.when(mul_season, F.transform(first, lambda v: F.try_divide(v, F.col("_m1")))).otherwise(q0)
    q0 = F.when(F.col("seasonal") == "none", F.array(F.lit(0.0))).otherwise(q0)

    def step(weights, state, y):
        a, b, g, phi = (weights[c] for c in tails)
        level, slope_, queue = state["l"], state["b"], state["q"]
        head = queue[0]
        base = level + phi * slope_
        if any_mul:
            base = F.when(mul_trend, level * F.pow(slope_, phi)).otherwise(base)
        fitted, without = base + head, y - head
        if any_mul:
            fitted = F.when(mul_season, base * head).otherwise(fitted)
            without = F.when(mul_season, F.try_divide(y, head)).otherwise(without)
        new = a * without + (1 - a) * base
        moved = b * (new - level) + (1 - b) * phi * slope_
        swing = g * (y - base) + (1 - g) * head
        if any_mul:
            moved = F.when(
                mul_trend, b * F.try_divide(new, level) + (1 - b) * F.pow(slope_, phi)
            ).otherwise(moved)
            swing = F.when(mul_season, g * F.try_divide(y, base) + (1 - g) * head).otherwise(swing)
        return F.struct(
            new.alias("l"),
            moved.alias("b"),
            F.concat(F.slice(queue, F.lit(2), F.size(queue)), F.array(swing)).alias("q"),
            (state["sse"] + F.when(state["i"] >= F.col("_from"), (y - fitted) * (y - fitted)).otherwise(0.0)).alias("sse"),
            (state["i"] + 1).alias("i"),
        )

    start = F.struct(
        F.col("_m1").alias("l"), b0.cast("double").alias("b"), q0.alias("q"), F.lit(0.0).alias("sse"), s.cast("int").alias("i")
    )
    later = F.slice("ys", s + 1, F.col("n"))
    if search:
        rows = simplex.searched(rows.withColumn("_start", start), {h: list(w.values()) for h, w in variants.items()})
    weights_ = {n: F.col(n) for n in tails}
    folded = F.aggregate(later, start, lambda state, y: step(weights_, state, y))
    used = (F.col("n") - F.col("_from")).cast("double")
    weights = (
        1
        + (F.col("trend") != "none").cast("int") * 2
        + F.when(F.col("seasonal") != "none", 1 + s).otherwise(0)
        + F.col("damped").cast("int")
        + 1
    )
    fitted = (
        rows.withColumn("_f", folded)
        .select(
            *keys,
            "_cid",
            *fields,
            "n",
            "shift",
            F.col("_f.l").alias("level"),
            F.col("_f.b").alias("slope"),
            F.col("_f.q").alias("queue"),
            F.col("_f.sse").alias("sse"),
            (used * F.log(F.greatest(F.col("_f.sse") / used, F.lit(1e-300))) + 2 * weights).alias("aic"),
            F.lit("fitted").alias("status"),
        )
    )
    plain = {"trend": "none", "seasonal": "none", "damped": False, "season": 1, "alpha": 1.0, "beta": 0.0, "gamma": 0.0, "phi": 1.0}
    none = F.lit(None).cast("double")
    short = arrays.where(F.size("ys") < min(needed.values())).select(
        *keys,
        F.lit(-1).alias("_cid"),
        *[F.lit(v).alias(n) for n, v in plain.items()],
        F.size("ys").alias("n"),
        F.lit(0.0).alias("shift"),
        F.element_at("ys", -1).alias("level"),
        F.lit(0.0).alias("slope"),
        F.array(F.lit(0.0)).alias("queue"),
        none.alias("sse"),
        none.alias("aic"),
        F.lit("fallback").alias("status"),
    )
    return fitted.unionByName(short)


def pick_best(fitted: DataFrame, keys: list[str], measure: str = "aic") -> DataFrame:
    """The candidate with the smallest measure per series; ties go to the first candidate."""
    rest = [c for c in fitted.columns if c not in keys]
    order = F.struct(F.coalesce(measure, F.lit(float("inf"))).alias("m"), "_cid")
    best = fitted.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest if c != "_cid"])


def smoothing_forecast(best: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """Forecast steps from the final state: keys, step, y_pred, status."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    h = F.col("step")
    damp = F.when(F.col("phi") == 1, h.cast("double")).otherwise(
        F.try_divide(F.col("phi") * (1 - F.pow("phi", h)), 1 - F.col("phi"))
    )
    season = F.col("queue")[F.pmod(h - 1, F.size("queue"))]
    path = F.when(F.col("trend") == "mul", F.col("level") * F.pow("slope", damp)).otherwise(
        F.col("level") + damp * F.col("slope")
    )
    full = F.when(F.col("seasonal") == "mul", path * season).otherwise(path + season)
    return best.select("*", steps).select(*keys, "step", (full - F.col("shift")).alias("y_pred"), "status")


def smoothing_auto(
    df: DataFrame, keys: list[str], time: str, y: str, season: int | None, horizon: int
) -> DataFrame:
    """Best additive smoothing model per series by AIC; too short a series repeats its last value.

    Weights are searched for each variant. ``status`` says which of the two a forecast is.
    """
    arrays = series_arrays(df, keys, time, y)
    fitted = smooth(arrays, keys, all_variants(season), search=True)
    return smoothing_forecast(pick_best(fitted, keys), keys, horizon)
