"""G and H: splits, sampling, sort, top-n, set operations, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.operators import split
from tidecast.operators.reshape import append_horizon, tagged_union, to_long
from tidecast.operators.windows import lag_columns, series
from tidecast.queries.registry import (
    F1,
    F2,
    F4,
    F5,
    PREDICTIONS,
    daily,
    event_days,
    hash_sql,
    monthly,
    predictions,
    query,
    read,
    rounded,
    split_sql,
    weekly,
)

KEY = ["o_orderkey"]
ORDERED = f"""(SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY cast(o_orderdate AS date), {hash_sql('o_orderkey')}) - 1 AS pos,
  count(*) OVER () AS n FROM orders)"""


@query(
    "g01_temporal_split_dates",
    f"""SELECT o_orderkey, CASE WHEN cast(o_orderdate AS date) <= (SELECT cast(o_orderdate AS date) FROM {ORDERED} c
        WHERE pos = cast(floor(n * 0.8) AS bigint) - 1) THEN 'train' ELSE 'test' END AS split FROM orders""",
)
def split_dates(spark, sf):
    return split.temporal_split(read(spark, sf, "orders"), "o_orderdate").select("o_orderkey", "split")


@query(
    "g01_temporal_split_rows",
    f"SELECT o_orderkey, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM {ORDERED} x",
)
def split_rows(spark, sf):
    df = split.temporal_split(read(spark, sf, "orders"), "o_orderdate", whole_dates=False, key=KEY)
    return df.select("o_orderkey", "split")


@query(
    "g02_random_split",
    f"""SELECT o_orderkey, CASE WHEN {split_sql('o_orderkey')} = 'test' THEN 'test'
        WHEN substr({hash_sql('o_orderkey', seed=43)}, 1, 8) < '33333333' THEN 'val' ELSE 'train' END AS split FROM orders""",
)
def random_split(spark, sf):
    outer = split.random_split(read(spark, sf, "orders"), KEY).withColumnRenamed("split", "outer_split")
    inner = split.random_split(outer, KEY, seed=43)
    label = (
        F.when(F.col("outer_split") == "test", "test").when(F.col("split") == "test", "val").otherwise("train")
    )
    return inner.select("o_orderkey", label.alias("split"))


@query(
    "g03_validation_tail",
    f"""SELECT o_orderkey, CASE WHEN pos >= floor(n * 0.8) THEN 'test' WHEN pos >= floor(floor(n * 0.8) * 0.8) THEN 'val' ELSE 'train' END AS split
        FROM {ORDERED} x""",
)
def validation_tail(spark, sf):
    df = split.temporal_split(read(spark, sf, "orders"), "o_orderdate", whole_dates=False, key=KEY)
    return split.validation_tail(df, "o_orderdate", 0.2, KEY).select("o_orderkey", "split")


@query(
    "g04_earliest_sample",
    f"SELECT o_orderkey FROM {ORDERED} x WHERE pos < greatest(1, floor(n * 0.3))",
)
def earliest_sample(spark, sf):
    return split.earliest(read(spark, sf, "orders"), "o_orderdate", 0.3, KEY).select("o_orderkey")


@query(
    "g05_growing_prefixes",
    f"SELECT size, o_orderkey FROM {ORDERED} x JOIN (VALUES (0.25), (0.5), (0.75), (1.0)) s(size) ON pos < floor(n * size)".replace(
        "SELECT size", "SELECT cast(size AS double) AS size"
    ),
)
def growing_prefixes(spark, sf):
    return split.growing_prefixes(read(spark, sf, "orders"), "o_orderdate", [0.25, 0.5, 0.75, 1.0], KEY).select(
        "size", "o_orderkey"
    )


@query("g06_sort", "SELECT o_orderkey, cast(cast(o_orderdate AS date) AS varchar) AS t, o_totalprice FROM orders ORDER BY 2, 3 DESC, 1")
def sort(spark, sf):
    df = read(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("t"), "o_totalprice")
    return df.orderBy("t", F.desc("o_totalprice"), "o_orderkey")


@query(
    "g07_top_n",
    """SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS int) AS rank
       FROM orders) x WHERE rank <= 3""",
)
def top_n(spark, sf):
    df = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return split.top_n_by_group(df, ["o_custkey"], "o_totalprice", 3, ["o_orderkey"])


@query(
    "g07_top_errors",
    f"""SELECT event_type, cast(t AS varchar) AS t, round(e, 2) + 0.0 AS e FROM (SELECT event_type, t,
        y - lag(y) OVER (PARTITION BY event_type ORDER BY t) AS e FROM {F5} x) z ORDER BY abs(e) DESC NULLS LAST, event_type, t LIMIT 15""",
)
def top_errors(spark, sf):
    df = event_days(spark, sf)
    e = F.col("y") - F.lag("y").over(series(["event_type"], "t"))
    return rounded(split.top_n(df.select("event_type", "t", e.alias("e")), "e", 15, ["event_type", "t"]), 2)


@query(
    "h01_append_horizon",
    f"""SELECT r_name, c_mktsegment, wk, y, lag(y, 1) OVER w AS lag_1, lag(y, 4) OVER w AS lag_4 FROM
        (SELECT r_name, c_mktsegment, wk, CASE WHEN wk <= 296 THEN y END AS y FROM {F2} x) z WINDOW w AS (PARTITION BY r_name, c_mktsegment ORDER BY wk)""",
)
def horizon(spark, sf):
    df = weekly(spark, sf).select("r_name", "c_mktsegment", "wk", "y")
    both = append_horizon(df.where("wk <= 296"), df.where("wk > 296").drop("y"), "wk", "y")
    return both.withColumns(lag_columns("y", [1, 4], series(["r_name", "c_mktsegment"], "wk")))


@query(
    "h02_tagged_union",
    f"""SELECT 'case1' AS case_id, NULL AS grp, cast(t AS varchar) AS t, y FROM {F1} a
        UNION ALL SELECT 'case4', p_type, cast(t AS varchar), sum(y) FROM {F4} b GROUP BY 2, 3""",
)
def union_cases(spark, sf):
    frames = {
        "case1": daily(spark, sf).drop("series_id"),
        "case4": monthly(spark, sf).groupBy(F.col("p_type").alias("grp"), "t").agg(F.sum("y").alias("y")),
    }
    return rounded(tagged_union(frames), 2)


@query(
    "h03_wide_to_long",
    f"""SELECT case_id, series_id, step, model, CASE WHEN case_id <> 'case3' OR model <> 'SeasonalNaive' THEN round(y_pred, 2) + 0.0 END AS value FROM {PREDICTIONS} x""",
)
def wide_to_long(spark, sf):
    models = ["Naive", "SeasonalNaive", "LinearRegression"]
    # Seasonal naive of case 3 is blanked, so that a missing value becomes a row.
    shown = predictions(spark, sf).withColumn("y_pred", F.when((F.col("case_id") != "case3") | (F.col("model") != "SeasonalNaive"), F.col("y_pred")))
    wide = shown.groupBy("case_id", "series_id", "step").pivot("model", models).agg(F.max("y_pred"))
    return rounded(to_long(wide, ["case_id", "series_id", "step"], models), 2)
