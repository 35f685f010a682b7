import pytest
from pyspark.sql import functions as F

from tidecast.operators import joins


@pytest.fixture(scope="module")
def tables(spark):
    # One key holds a third of the rows.
    fact = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).alias("k"), "id"
    )
    dim = spark.range(0, 900).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    return fact, dim


def test_hot_keys_are_found_in_one_pass(tables):
    fact, _ = tables
    assert joins.hot_keys(fact, ["k"], share=0.1) == [(7,)]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_split_equals_plain_join(tables, how):
    fact, dim = tables
    plain = fact.join(dim, "k", how)
    split = joins.lookup_join(fact, dim, ["k"], how, broadcast_rows=0)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, split.collect()), key=str)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_size_check_counts_rows_and_bytes(spark, monkeypatch):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"))
    assert joins.fits_broadcast(df, 100)
    assert not joins.fits_broadcast(df, 99)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 50_000)
    assert not joins.fits_broadcast(df, 100)


def test_lookup_default_and_row_selection(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    mapping = spark.createDataFrame([("a", 5.0)], "k string, v double")
    got = joins.lookup_with_default(df, mapping, "k", "v", -1.0).orderBy("id")
    assert [r["v"] for r in got.collect()] == [5.0, -1.0, -1.0]
    ids = spark.createDataFrame([(1,), (1,), (9,)], "id int")
    assert [r["id"] for r in joins.select_rows(df, ids, ["id"]).collect()] == [1]


def test_benchmark_and_gaps(spark):
    rows = spark.createDataFrame(
        [("c1", "Naive", 2.0), ("c1", "X", 1.0), ("c2", "Naive", 4.0)], "case_id string, model string, mae double"
    )
    got = {(r["case_id"], r["model"]): r["mae_Naive"] for r in joins.with_benchmark(rows, "case_id", "model", "mae", "Naive").collect()}
    assert got == {("c1", "Naive"): 2.0, ("c1", "X"): 2.0, ("c2", "Naive"): 4.0}
    assert [tuple(r) for r in joins.coverage_gaps(rows, "case_id", "model").collect()] == [("c2", "X")]
