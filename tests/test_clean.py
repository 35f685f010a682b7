import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.functions import text
from tidecast.functions.ratios import clip_zero, ratio_or_self, safe_ratio
from tidecast.operators import clean
from tidecast.operators.encode import full_statistic, ordered_statistic
from tidecast.operators.split import row_hash


def test_numbers_and_dates(spark):
    rows = [("1,200 ",), ("(100)",), ("-5",), ("1-2",), ("",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    got = df.select(text.parse_number(F.col("s")).alias("a"), text.parse_number(F.col("s"), True).alias("b")).collect()
    assert [r["a"] for r in got] == [1200.0, 100.0, -5.0, None, None, None]
    assert [r["b"] for r in got] == [1200.0, -100.0, -5.0, None, None, None]
    days = spark.createDataFrame([("13/45/2011",), ("1/2/2016",), ("1/31/2018 22:56",), (None,)], "s string")
    assert [str(r[0])[:10] for r in days.select(text.parse_timestamp(F.col("s"))).collect()] == ["None", "2016-01-02", "2018-01-31", "None"]


def test_names():
    assert text.clean_name("﻿Date") == "Date"
    assert text.slug("Days (real)/Unit Price") == "days_real_unit_price"


def test_imputation(spark):
    df = spark.createDataFrame([(1, "a"), (None, None), (3, "b"), (9, "b")], "n int, s string")
    assert clean.fit_imputer(df, ["n"]) == {"n": 3.0}
    assert clean.fit_imputer(df, ["n"], "mean")["n"] == pytest.approx(13 / 3)
    got = clean.fill_unknown(clean.apply_imputer(df, {"n": 3.0})).collect()
    assert [tuple(r) for r in got][1] == (3.0, "Unknown")
    with pytest.raises(ValueError):
        clean.fit_imputer(df, ["n"], "other")


def test_winsor_stays_in_bounds_and_keeps_nulls(spark):
    v = [float(x) for x in range(200)] + [-1e6, 1e6]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double")
    bounds = clean.fit_winsor(df, ["v"])
    assert bounds["v"] == pytest.approx((np.percentile(v, 1), np.percentile(v, 99)))
    out = clean.apply_winsor(df, bounds)
    s = out.agg(F.min("v"), F.max("v"), F.count("v"), F.count("*")).first()
    assert (s[0], s[1]) == pytest.approx(bounds["v"]) and s[2] + 1 == s[3]


def test_scaler_uses_population_deviation_and_survives_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert clean.fit_scaler(df, ["a", "b"]) == {"a": (2.0, 1.0), "b": (5.0, 1.0)}


def test_target_encoding_unseen_and_missing(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 8.0), (None, 4.0)], "c string, y double")
    other = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "id int, c string")
    got = clean.apply_target_encoding(other, "c", clean.fit_target_encoding(train, "c", "y")).orderBy("id")
    assert [r["c_encoded"] for r in got.collect()] == [2.0, 4.0, 4.0]
    assert "c" not in got.columns


def test_one_hot_drops_first_and_zeroes_unseen(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "c string")
    cats = clean.fit_one_hot(train, ["c"])
    assert cats == {"c": ["b", "c"]}
    got = clean.apply_one_hot(spark.createDataFrame([("c",), ("z",), (None,)], "c string"), cats).collect()
    assert [tuple(r) for r in got] == [(0, 1), (0, 0), (0, 0)]


def test_narrow_types_at_the_limits(spark):
    df = spark.createDataFrame([(126, 127, 1.5)], "a long, b long, c double")
    assert clean.narrow_types(df)[1] == {"a": "tinyint", "b": "smallint", "c": "float"}


def test_ratios(spark):
    df = spark.createDataFrame([(6.0, 3.0), (6.0, 0.0), (6.0, None), (-2.0, 1.0), (None, 1.0)], "a double, b double")
    got = df.select(safe_ratio(F.col("a"), F.col("b")), ratio_or_self(F.col("a"), F.col("b")), clip_zero(F.col("a"))).collect()
    assert [r[0] for r in got] == [2.0, 0.0, 0.0, -2.0, 0.0]
    assert [r[1] for r in got] == [2.0, 6.0, None, -2.0, None]
    assert [r[2] for r in got] == [6.0, 6.0, 6.0, 0.0, None]


@pytest.mark.parametrize("block", [10**6, 20])
def test_ordered_statistic_against_brute_force(spark, block):
    rows = [(i, "hot" if i % 3 else f"c{i % 4}", float(i % 11)) for i in range(400)] + [(1, "hot", 1.0)] * 150
    df = spark.createDataFrame(rows, "id int, c string, y double").repartition(6)
    got = ordered_statistic(df, "c", "y", ["id", "c", "y"], weight=2.0, block_rows=block)
    full = got.withColumn("h", row_hash(["id", "c", "y"])).collect()
    prior = sum(r["y"] for r in full) / len(full)
    assert len(full) == len(rows)
    for r in full:
        seen = [o["y"] for o in full if o["c"] == r["c"] and o["h"] < r["h"]]
        assert r["c_ordered"] == pytest.approx((sum(seen) + 2 * prior) / (len(seen) + 2))
    test = full_statistic(df, spark.createDataFrame([("new",)], "c string"), "c", "y").first()
    assert test["c_ordered"] == pytest.approx(prior)
