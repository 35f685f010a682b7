import pytest
from pyspark.sql import functions as F

from tidecast.operators import split

KEY = ["id"]


@pytest.fixture(scope="module")
def table(spark):
    # The cut date holds most rows.
    return spark.range(1000).select(
        "id",
        F.when(F.col("id") < 100, "2020-01-01").when(F.col("id") < 900, "2020-01-02").otherwise("2020-01-03").cast("date").alias("t"),
    )


def counts(df, column="split"):
    return {r[0]: r[1] for r in df.groupBy(column).count().collect()}


@pytest.mark.parametrize("fraction", [0.0, 0.001, 0.333, 0.8, 0.95, 1.0])
def test_row_split_is_exact_and_in_time_order(table, fraction):
    got = split.temporal_split(table, "t", fraction, whole_dates=False, key=KEY)
    k = int(1000 * fraction)
    assert counts(got).get("train", 0) == k
    edge = got.groupBy("split").agg(F.min("t").alias("a"), F.max("t").alias("b")).collect()
    span = {r["split"]: (r["a"], r["b"]) for r in edge}
    if len(span) == 2:
        assert span["train"][1] <= span["test"][0]


def test_order_within_a_date_is_the_hash(table):
    got = split.temporal_split(table, "t", 0.5, whole_dates=False, key=KEY).withColumn("h", split.row_hash(KEY))
    day = got.where("t = date'2020-01-02'").select("h", "split").orderBy("h").collect()
    labels = [r["split"] for r in day]
    assert labels == sorted(labels, reverse=True)


def test_deep_hash_search(table, monkeypatch):
    whole = split.temporal_split(table, "t", 0.5, whole_dates=False, key=KEY).collect()
    monkeypatch.setattr(split, "ORDERED_HASHES", 3)
    monkeypatch.setattr(split, "PREFIX", 1)
    deep = split.temporal_split(table, "t", 0.5, whole_dates=False, key=KEY).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, deep))


def test_copies_of_one_row_are_divided(spark, monkeypatch):
    monkeypatch.setattr(split, "CHUNK", 70)
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("id"), F.lit("2020-01-01").cast("date").alias("t"))
    place = sorted((split_hash, i) for split_hash, i in {(r["h"], r["id"]) for r in df.select("id", split.row_hash(KEY).alias("h")).collect()})
    before = [i for _, i in place].index(-1)
    for rows in (before, before + 1, before + 150, before + 300, before + 301):
        got = split.segments(df, "t", [rows], KEY)
        assert counts(got, "segment").get(0, 0) == rows
        assert got.count() == 900
    two = split.segments(df, "t", [before + 100, before + 200], KEY)
    assert counts(two, "segment") == {0: before + 100, 1: 100, 2: 700 - before}


def test_whole_dates(table):
    assert counts(split.temporal_split(table, "t", 0.5)) == {"train": 900, "test": 100}
    ts = table.withColumn("t", F.col("t").cast("timestamp") + F.expr("interval 5 hours"))
    assert counts(split.temporal_split(ts, "t", 0.5)) == {"train": 900, "test": 100}


def test_random_split_ignores_partitioning(table):
    a = split.random_split(table.repartition(1), KEY).orderBy("id").collect()
    b = split.random_split(table.repartition(7), KEY).orderBy("id").collect()
    assert a == b
    assert 0.15 < counts(split.random_split(table, KEY))["test"] / 1000 < 0.25


def test_tail_earliest_prefixes_ranges(table):
    base = split.temporal_split(table, "t", 0.8, whole_dates=False, key=KEY)
    assert counts(split.validation_tail(base, "t", 0.2, KEY)) == {"train": 640, "val": 160, "test": 200}
    assert split.earliest(table, "t", 0.3, KEY).count() == 300
    assert split.earliest(table.limit(1), "t", 0.3, KEY).count() == 1
    assert counts(split.growing_prefixes(table, "t", [0.25, 1.0], KEY), "size") == {0.25: 250, 1.0: 1000}
    weeks = table.withColumn("w", F.col("id").cast("int"))
    got = split.range_split(weeks, "w", {"train": (1, 100), "val": (101, 125)})
    assert counts(got) == {"train": 100, "val": 25, None: 875}


def test_top_n(spark):
    df = spark.createDataFrame([("a", -5.0), ("b", 4.0), ("c", 1.0)], "k string, s double")
    assert [r["k"] for r in split.top_n(df, "s", 2, ["k"]).collect()] == ["a", "b"]
    plan = split.top_n_by_group(df, ["k"], "s", 1, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_undated_rows_come_last(table):
    df = table.withColumn("t", F.when(F.col("id") >= 50, F.col("t")))
    got = split.temporal_split(df, "t", 0.5, whole_dates=False, key=KEY)
    assert counts(got) == {"train": 500, "test": 500}
    assert got.where("t IS NULL AND split = 'train'").count() == 0
    with pytest.raises(ValueError, match="without a date"):
        split.temporal_split(df, "t", 1.0)
    with pytest.raises(ValueError):
        split.random_split(df, KEY, 1.0)


def test_rows_that_differ_by_microseconds_or_inside_values_are_all_kept(spark):
    """One key, one date: rows apart by a microsecond, by the last bit of a number, or within a nested value."""
    from pyspark.sql import functions as F

    ids = spark.range(8)
    rows = ids.select(
        F.lit("k").alias("k"), F.timestamp_micros(F.lit(1_577_836_800_123_000) + F.col("id").cast("long")).alias("ts"),
        (F.lit(0.1) + F.col("id") * F.lit(2.0**-55)).alias("x"), F.array(F.struct(F.timestamp_micros(F.lit(5) + F.col("id")).alias("at"))).alias("inner"),
        F.create_map(F.lit("a"), F.col("id")).alias("m"), F.encode(F.col("id").cast("string"), "utf-8").alias("b"),
    )
    whole = sorted(map(str, rows.collect()))
    for columns in (rows.columns, ["k", "ts"], ["k", "ts", "inner"]):
        part = rows.select(columns)
        done = split.temporal_split(part, "ts", 0.5, whole_dates=False, key=["k"])
        assert done.where("split = 'train'").count() == 4
        assert sorted(map(str, done.drop("split").collect())) == sorted(map(str, part.collect()))
    assert len(whole) == len(set(whole)) == 8
