import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast import session
from tidecast.operators import aggregate as agg
from tidecast.operators import reshape
from tidecast.plans import cleaning, features
from tidecast.schemas import CROSS_SECTION, DAILY_SERIES, ENTITY_PANEL, WEEKLY_PANEL, allowed_columns
from tidecast.sources import tables


def write(path, data):
    with open(path, "wb") as f:
        f.write(data)
    return str(path)


def test_encodings_and_bom(spark, tmp_path):
    latin = write(tmp_path / "l.csv", "k,v\nñandú,1\n".encode("latin-1"))
    utf = write(tmp_path / "u.csv", "﻿k,v\nñandú,1\n".encode("utf-8"))
    for path, encoding in ((latin, "ISO-8859-1"), (utf, "UTF-8")):
        assert tables.choose_encoding(spark, path) == encoding
        got = tables.read_csv(spark, path, encoding="auto")
        assert got.columns == ["k", "v"] and got.first()["k"] == "ñandú"


def test_csv_round_trip_keeps_every_value(spark, tmp_path):
    rows = [(1, 'a "quoted", text'), (2, " spaces "), (3, "line\nbreak"), (4, "back\\slash"), (5, None)]
    df = spark.createDataFrame(rows, "id int, s string")
    tables.write_table(df, str(tmp_path / "t.csv"))
    got = tables.read_table(spark, str(tmp_path / "t.csv"), schema=df.schema, line_breaks=True).orderBy("id").collect()
    assert [tuple(r) for r in got] == rows


def test_case_scan_checks_its_target(spark, tmp_path):
    path = write(tmp_path / "c.csv", b"Product_Code,Warehouse,Product_Category,Date,Order_Demand\nP,W,C,1/2/2016,(10)\n")
    assert tables.load_case(spark, path, DAILY_SERIES).first()["Order_Demand"] == "(10)"
    other = str(tmp_path / "o.parquet")
    spark.range(1).write.parquet(other)
    with pytest.raises(ValueError, match="missing columns"):
        tables.load_case(spark, other, DAILY_SERIES)
    with pytest.raises(ValueError, match="unsupported format"):
        tables.format_of("x.pkl")


def test_case_files_union_missing_columns(spark, tmp_path):
    write(tmp_path / "case1_results.csv", b"model,mae\nNaive,1.5\n")
    write(tmp_path / "case2_results.csv", b"model,rmsle,mae\nNaive,0.1,2\n")
    write(tmp_path / "notes.csv", b"x\n1\n")
    schema = T.StructType([T.StructField("model", T.StringType()), T.StructField("mae", T.DoubleType()), T.StructField("rmsle", T.DoubleType())])
    got = tables.scan_case_files(spark, str(tmp_path), r"(case\d+)_results", schema).orderBy("case_id").collect()
    assert [(r["case_id"], r["mae"], r["rmsle"]) for r in got] == [("case1", 1.5, None), ("case2", 2.0, 0.1)]


class Settings:
    """A session stand-in with one setting and a master address."""

    def __init__(self, folder, master):
        self.conf = self
        self.sparkContext = self
        self.folder, self.master = folder, master

    def get(self, key, default=None):
        return self.folder or default

    def getConf(self):
        return self


def test_shared_folder(spark):
    assert session.shared_dir(Settings("/shared/folder/", "spark://cluster")) == "/shared/folder"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Settings(None, "spark://cluster"))
    assert session.fresh_path(spark, "x") != session.fresh_path(spark, "x")
    kept = session.materialise(spark.range(5), "five")
    assert kept.count() == 5 and kept.columns == ["id"]


def test_summary_profile_and_cardinality(spark):
    df = spark.createDataFrame([(1.0, "a", None), (0.0, "b", "x"), (-4.0, "a", None)], "y double, c string, d string")
    assert tuple(agg.dataset_summary(df).first()) == (3, 3, 2, pytest.approx(200 / 9))
    p = agg.target_profile(df, "y").first()
    assert (p["y_median"], p["zeros"], p["negatives"], p["y_std"]) == (0.0, 1, 1, pytest.approx(np.std([1, 0, -4])))
    assert [tuple(r) for r in agg.cardinalities(df).collect()] == [("c", 2), ("d", 1)]


def test_histogram_density_and_box(spark):
    rng = np.random.default_rng(0)
    v = np.r_[rng.normal(size=400), [9.0]]
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("same", 2.0)] * 5, "g string, v double")
    a = df.where("g = 'a'")
    got = {r["bin"]: r for r in agg.histogram(a, "v", 12).collect()}
    n, _ = np.histogram(v, 12)
    assert {i: r["n"] for i, r in got.items()} == {i: c for i, c in enumerate(n) if c}
    flat = agg.histogram(df, "v", 12, ["g"]).where("g = 'same'").first()
    assert (flat["bin"], flat["n"], flat["density"]) == (0, 5, None)
    d = agg.kernel_density(a, "v", 40).orderBy("i").toPandas()
    assert np.trapezoid(d["density"], d["x"]) == pytest.approx(1, abs=0.01)
    box = {r["g"]: r for r in agg.box_summary(df, "v", ["g"]).collect()}
    q1, q3 = np.percentile(v, [25, 75])
    inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
    assert (box["a"]["whisker_low"], box["a"]["whisker_high"]) == (inside.min(), inside.max())
    assert box["a"]["outliers"] == len(v) - len(inside) and box["same"]["outliers"] == 0


def test_regression_ignores_missing_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (9.0, None), (None, 1.0)], "x double, y double")
    fit = agg.simple_regression(df, "y", "x").first()
    assert (fit["slope"], fit["intercept"], fit["r2"]) == pytest.approx((2, 0, 1))


def test_horizon_must_follow_training(spark):
    train = spark.createDataFrame([(1, 2.0), (2, 3.0)], "t int, y double")
    with pytest.raises(ValueError):
        reshape.append_horizon(train, spark.createDataFrame([(2,)], "t int"), "t", "y")
    got = reshape.append_horizon(train, spark.createDataFrame([(3, "x")], "t int, extra string"), "t", "y")
    assert got.count() == 3 and got.where("t = 3").first()["y"] is None


def orders(spark):
    rows = [(f"P{i % 3}", f"{i % 28 + 1}", float(i % 17)) for i in range(300)]
    df = spark.createDataFrame(rows, "Product_Code string, d string, Order_Demand double")
    return df.withColumn("Date", F.to_date(F.concat(F.lit("2016-01-"), F.lpad("d", 2, "0")))).drop("d")


def test_daily_plan(spark):
    raw = orders(spark).unionByName(spark.createDataFrame([("P", -50.0, None)], "Product_Code string, Order_Demand double, Date date"))
    clean = cleaning.clean_daily(raw, DAILY_SERIES)
    assert clean.count() == 300 and clean.agg(F.min("Order_Demand")).first()[0] >= 0
    out = features.daily_features(clean, DAILY_SERIES)
    assert out.count() == 14 and out.agg(F.min("time_index")).first()[0] == 14
    assert {"lag_14", "rolling_std_7", "is_month_end", "quarter_cos"} <= set(out.columns)


def test_statistics_come_from_training_rows(spark):
    df = orders(spark)
    train = df.where("Order_Demand < 5")
    assert cleaning.clean_daily(df, DAILY_SERIES, train).agg(F.max("Order_Demand")).first()[0] <= 4


def test_weekly_and_panel_plans(spark):
    week = spark.range(1, 31).select(
        F.col("id").cast("int").alias("week"), F.lit(1).alias("city_code"), F.lit("x").alias("category"), F.lit(9.0).alias("checkout_price"),
        F.when(F.col("id") == 3, 0.0).otherwise(10.0).alias("base_price"), F.lit(1).alias("emailer_for_promotion"), F.lit(0).alias("homepage_featured"),
        F.col("id").cast("double").alias("num_orders"), F.col("id").alias("id"),
    )
    out = features.weekly_features(cleaning.clean_weekly(week, WEEKLY_PANEL), WEEKLY_PANEL).orderBy("week").collect()
    assert out[2]["price_ratio"] == 0.0 and out[2]["discount_percent"] == -900.0 and out[13]["quarter"] == 2
    assert out[9]["lag_8"] == 2.0 and out[9]["rolling_mean_4"] == 7.5 and "id" not in out[0].asDict()
    panel = spark.range(20).select(
        F.date_add(F.lit("2022-01-01").cast("date"), F.col("id").cast("int")).alias("Date"), F.lit("S").alias("Store ID"), F.lit("P").alias("Product ID"),
        F.lit(20.0).alias("Price"), F.lit(0.0).alias("Competitor Pricing"), F.lit(10.0).alias("Discount"), F.lit(0.0).alias("Inventory Level"),
        F.lit(5.0).alias("Units Ordered"), F.col("id").cast("double").alias("Units Sold"), F.lit(1.0).alias("Demand Forecast"),
    )
    got = features.panel_features(cleaning.clean_panel(panel, ENTITY_PANEL), ENTITY_PANEL)
    assert got.count() == 13 and "Demand Forecast" not in got.columns
    one = got.first()
    assert (one["price_ratio"], one["inventory_to_order_ratio"], one["price_after_discount"]) == (20.0, 0.0, 18.0)


def test_cross_section_plan_keeps_only_allowed_columns(spark):
    cols = {c: float(i) for i, c in enumerate(CROSS_SECTION.numeric, 1)}
    texts = {c: "x" for c in (*CROSS_SECTION.categorical, *CROSS_SECTION.target_encoded)}
    row = {**cols, **texts, CROSS_SECTION.target: 3.0, CROSS_SECTION.time: "2018-01-31 22:56:00", "Delivery Status": "Late", "Shipping Mode": "Same Day"}
    df = spark.createDataFrame([row] * 3).withColumn(CROSS_SECTION.time, F.to_timestamp(F.col(f"`{CROSS_SECTION.time}`")))
    out = cleaning.clean_cross_section(df, CROSS_SECTION)
    assert "Delivery Status" not in out.columns and "Order Country_encoded" in out.columns
    assert allowed_columns(df, CROSS_SECTION)[0] == CROSS_SECTION.target
    got = features.cross_section_features(out, CROSS_SECTION).first()
    assert (got["shipping_mode_rank"], got["is_expedited"], got["order_month"]) == (0, 1, 1)
    assert got["order_value_per_unit"] == 2.0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not present")
@pytest.mark.parametrize("name", ["a02_encoding_fallback", "b05_week_ranges", "e16_box_summary", "f09_decompose_even", "g01_temporal_split_rows", "j06_all_metrics", "k03_simple_smoothing", "k13_ordered_statistic", "k22_daily_features"])
def test_queries_match_reference_sql(spark, name):
    import __spark_entry__ as entry
    from tests.oracle import compare, connect

    sf = "/root/testdata/sf0.001"
    assert compare(connect(sf), name, entry.queries()[name](spark, sf), entry.oracle_sql()[name]) is None


def test_registry_is_complete():
    import __spark_entry__ as entry

    ids = {n.split("_")[0] for n in entry.queries() if n not in entry.CORPUS_QUERIES}
    sizes = {"a": 13, "b": 11, "c": 13, "d": 5, "e": 19, "f": 11, "g": 7, "h": 3, "i": 13, "j": 13, "k": 24}
    assert ids == {f"{s}{i:02d}" for s, n in sizes.items() for i in range(1, n + 1)}
    assert set(entry.oracle_sql()) <= set(entry.queries())
