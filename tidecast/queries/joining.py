"""D: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.operators import joins
from tidecast.queries.registry import F5, RESULTS, event_days, query, r, read, results, rounded


@query(
    "d01_lookup_default",
    """SELECT o_orderkey, coalesce(c_mktsegment, 'Unknown') AS c_mktsegment FROM orders
       LEFT JOIN (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0) c ON o_custkey = c_custkey""",
)
def lookup_default(spark, sf):
    mapping = read(spark, sf, "customer").where("c_custkey % 3 <> 0").select("c_custkey", "c_mktsegment")
    orders = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return joins.lookup_with_default(orders, mapping, "c_custkey", "c_mktsegment", "Unknown").drop("c_custkey")


@query(
    "d02_select_rows",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def select_rows(spark, sf):
    ids = read(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.select_rows(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), ids, ["o_custkey"])


@query(
    "d03_align",
    f"""SELECT event_type, cast(t AS varchar) AS t, round(a.y, 2) + 0.0 AS y_true, round(p.y, 2) + 0.0 AS y_pred FROM {F5} a
        JOIN (SELECT event_type, t + 1 AS t, y FROM {F5} b) p USING (event_type, t)""",
)
def align(spark, sf):
    actual = event_days(spark, sf)
    predicted = actual.select("event_type", F.date_add("t", 1).alias("t"), F.col("y").alias("y_pred"))
    pairs = joins.align(actual.withColumnRenamed("y", "y_true"), predicted, ["event_type", "t"])
    return rounded(pairs, 2)


@query(
    "d04_benchmark",
    f"""SELECT x.case_id, x.model, round(x.mae, 3) + 0.0 AS mae, round(b.mae, 3) + 0.0 AS naive_mae FROM {RESULTS} x
        JOIN {RESULTS} b ON x.case_id = b.case_id AND b.model = 'Naive'""",
)
def benchmark(spark, sf):
    rows = joins.with_benchmark(results(spark, sf), "case_id", "model", "mae", "Naive")
    return rows.select("case_id", "model", r("mae", 3).alias("mae"), r("mae_Naive", 3).alias("naive_mae"))


@query(
    "d05_coverage_gaps",
    f"""SELECT case_id, model FROM (SELECT DISTINCT case_id FROM {RESULTS} a) c, (SELECT DISTINCT model FROM {RESULTS} b) m
        EXCEPT SELECT case_id, model FROM {RESULTS} d WHERE case_id <> 'case3' OR model <> 'SeasonalNaive'""",
)
def coverage_gaps(spark, sf):
    # One result is taken away, so that there is a gap.
    return joins.coverage_gaps(results(spark, sf).where("case_id <> 'case3' OR model <> 'SeasonalNaive'"), "case_id", "model")
