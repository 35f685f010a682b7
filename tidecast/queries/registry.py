"""Query registry, test-table readers and the table shapes the queries run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators.aggregate import money_sum
from tidecast.operators.joins import lookup_join
from tidecast.session import materialise, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Added before ``floor`` it rounds every double below 2**52 half up.
HALF = float.fromhex("0x1.fffffffffffffp-2")


def r(c: Column | str, digits: int = 6) -> Column:
    """Double rounded half away from zero in binary, as the reference SQL rounds; no negative zero."""
    col = (F.col(c) if isinstance(c, str) else c).cast("double")
    scale = F.lit(10.0**digits)
    # The double before a half: a half itself would lift the double before 0.5 to 1, and 0.03 / 600 to 0.0001.
    grown = F.abs(col) * scale + HALF
    # From 2**52 on a double has no decimals left to round, and ``floor`` returns a 64-bit integer.
    return F.when(grown < 2.0**52, F.signum(col) * (F.floor(grown) / scale) + F.lit(0.0)).otherwise(col)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column and turn dates into text, for comparison."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind in ("double", "float"):
            c = r(c, digits)
        elif kind == "date":
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def days(ts: str) -> Column:
    return F.to_date(F.col(ts))


# Daily series: total order value per day.
F1 = """(SELECT cast(o_orderdate AS date) AS t,
  cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS y FROM orders GROUP BY 1)"""


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """series_id, t, y."""
    orders = read(spark, sf, "orders")
    return (
        orders.groupBy(days("o_orderdate").alias("t"))
        .agg(money_sum("o_totalprice").alias("y"))
        .select(F.lit("all").alias("series_id"), "t", "y")
    )


# Weekly panel: quantities, unit values and promotion flags per region, segment and week.
F2 = """(SELECT r_name, c_mktsegment,
  cast(floor(date_diff('day', DATE '1995-01-01', cast(o_orderdate AS date)) / 7.0) AS int) + 1 AS wk,
  cast(sum(cast(l_quantity AS decimal(18,2))) AS double) AS y,
  cast(sum(cast(l_extendedprice AS decimal(18,2))) AS double)
    / cast(sum(cast(l_quantity AS decimal(18,2))) AS double) AS base_price,
  cast(sum(cast(l_extendedprice AS decimal(18,2)) * (1 - cast(l_discount AS decimal(4,2)))) AS double)
    / cast(sum(cast(l_quantity AS decimal(18,2))) AS double) AS checkout_price,
  max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS emailer,
  max(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS homepage
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3)"""


def week_of(ts: str) -> Column:
    return (F.floor(F.datediff(days(ts), F.lit("1995-01-01").cast("date")) / 7) + 1).cast("int")


def weekly(spark: SparkSession, sf: str) -> DataFrame:
    """r_name, c_mktsegment, wk, y, base_price, checkout_price, emailer, homepage.

    Each join is preceded by a roll-up to its own key, so a hot order, customer or nation is a few
    rows by the time it is joined. The panel is written once: fits, quantiles and outputs read it
    again, and each would join the large tables once more.
    """
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    per_order = (
        spread(read(spark, sf, "lineitem"), "l_orderkey")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"),
            F.sum(price).alias("gross"),
            F.sum(price * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("net"),
        )
    )
    orders = read(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("c_custkey"),
        week_of("o_orderdate").alias("wk"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("emailer"),
        (F.col("o_orderpriority") == "2-HIGH").cast("int").alias("homepage"),
    )

    def roll(df, *keys):
        return df.groupBy(*keys).agg(
            *[F.sum(c).alias(c) for c in ("q", "gross", "net")],
            *[F.max(c).alias(c) for c in ("emailer", "homepage")],
        )

    per_customer = roll(orders.join(per_order, "o_orderkey"), "c_custkey", "wk")
    customers = read(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    per_nation = roll(
        lookup_join(per_customer, customers, ["c_custkey"], "inner"), "c_nationkey", "c_mktsegment", "wk"
    )
    places = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    placed = lookup_join(
        per_nation, places.select(F.col("n_nationkey").alias("c_nationkey"), "r_name"), ["c_nationkey"], "inner"
    )
    q = F.col("q").cast("double")
    panel = roll(placed, "r_name", "c_mktsegment", "wk").select(
        "r_name",
        "c_mktsegment",
        "wk",
        q.alias("y"),
        (F.col("gross").cast("double") / q).alias("base_price"),
        (F.col("net").cast("double") / q).alias("checkout_price"),
        "emailer",
        "homepage",
    )
    return materialise(panel, "weekly")


# Cross-section: one row per line, with order, customer, place and part attributes.
F3 = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
  l_returnflag, l_linestatus, l_shipdate, o_orderdate, o_orderpriority, c_mktsegment, c_acctbal,
  n_name, p_brand, p_type, p_size, p_retailprice, l_quantity + l_tax AS leak
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def lines(spark: SparkSession, sf: str) -> DataFrame:
    customers = read(spark, sf, "customer").join(
        read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    orders = lookup_join(
        read(spark, sf, "orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderpriority"
        ),
        customers.select("c_custkey", "c_mktsegment", "c_acctbal", "n_name"),
        ["c_custkey"],
        "inner",
    ).drop("c_custkey")
    parts = read(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_size", "p_retailprice"
    )
    with_part = lookup_join(spread(read(spark, sf, "lineitem")), parts, ["l_partkey"], "inner")
    return lookup_join(with_part, orders, ["l_orderkey"], "inner").withColumn(
        "leak", F.col("l_quantity") + F.col("l_tax")
    )


# Entity panel: monthly quantities and prices per supplier nation and part type.
F4 = """(SELECT s_nationkey, p_type, cast(date_trunc('month', l_shipdate) AS date) AS t,
  cast(sum(cast(l_quantity AS decimal(18,2))) AS double) AS y,
  cast(sum(cast(l_extendedprice AS decimal(18,2))) AS double)
    / cast(sum(cast(l_quantity AS decimal(18,2))) AS double) AS price,
  cast(sum(cast(p_retailprice AS decimal(18,2))) AS double) / count(*) AS competitor,
  100 * cast(sum(cast(l_discount AS decimal(4,2))) AS double) / count(*) AS discount,
  cast(sum(p_size) AS double) AS inventory,
  cast(sum(cast(l_quantity AS decimal(18,2))) AS double) + count(*) / 100.0 AS leak
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2, 3)"""


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """s_nationkey, p_type, t, y, price, competitor, discount, inventory, leak.

    Parts and suppliers are looked up; the one shuffle carries sums per nation, type and month.
    """
    line = spread(read(spark, sf, "lineitem")).select(
        "l_partkey",
        "l_suppkey",
        F.to_date(F.date_trunc("month", "l_shipdate")).alias("t"),
        *[F.col(c).cast(f"decimal({p},2)").alias(c) for c, p in (("l_quantity", 18), ("l_extendedprice", 18), ("l_discount", 4))],
    )
    parts = read(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_type", "p_size", F.col("p_retailprice").cast("decimal(18,2)").alias("retail")
    )
    suppliers = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    joined = lookup_join(lookup_join(line, parts, ["l_partkey"], "inner"), suppliers, ["l_suppkey"], "inner")
    q, n = F.sum("l_quantity").cast("double"), F.count("*")
    return joined.groupBy("s_nationkey", "p_type", "t").agg(
        q.alias("y"),
        (F.sum("l_extendedprice").cast("double") / q).alias("price"),
        (F.sum("retail").cast("double") / n).alias("competitor"),
        (100 * F.sum("l_discount").cast("double") / n).alias("discount"),
        F.sum("p_size").cast("double").alias("inventory"),
        (q + n / 100).alias("leak"),
    )


# Event series: total value per event type and day.
F5 = """(SELECT event_type, cast(ts AS date) AS t, cast(sum(cast(value AS decimal(18,2))) AS double) AS y
  FROM events GROUP BY 1, 2)"""


def event_days(spark: SparkSession, sf: str, key: str = "event_type") -> DataFrame:
    return read(spark, sf, "events").groupBy(key, days("ts").alias("t")).agg(money_sum("value").alias("y"))


def hash_sql(*keys: str, seed: int = 42) -> str:
    parts = ", ".join(f"coalesce(cast({k} AS varchar), '~')" for k in keys)
    return f"md5(concat_ws('|', {parts}, '{seed}'))"


def split_sql(*keys: str) -> str:
    return f"CASE WHEN substr({hash_sql(*keys)}, 1, 8) < '33333333' THEN 'test' ELSE 'train' END"


# All series of the four shapes with positions and an 80/20 split per series.
SERIES = f"""(SELECT *, CASE WHEN pos < n_train THEN 'train' ELSE 'test' END AS split,
    CASE WHEN pos >= n_train THEN pos - n_train + 1 END AS step FROM (
  SELECT case_id, series_id, season, y, cast(floor(count(*) OVER (PARTITION BY case_id, series_id) * 0.8) AS int) AS n_train,
    cast(row_number() OVER (PARTITION BY case_id, series_id ORDER BY t) - 1 AS int) AS pos FROM (
  SELECT 'case1' AS case_id, 'all' AS series_id, 7 AS season, date_diff('day', DATE '1970-01-01', t) AS t, y FROM {F1} a
  UNION ALL SELECT 'case2', r_name, 4, wk, sum(y) FROM {F2} b GROUP BY 2, 4
  UNION ALL SELECT 'case3', 'all', 7, date_diff('day', DATE '1970-01-01', cast(l_shipdate AS date)),
    cast(sum(cast(l_quantity AS decimal(18,2))) AS double) / count(*) FROM lineitem GROUP BY 4
  UNION ALL SELECT 'case4', p_type, 12, date_diff('day', DATE '1970-01-01', t), sum(y) FROM {F4} d GROUP BY 2, 4
  ) u) v)"""


def all_series(spark: SparkSession, sf: str) -> DataFrame:
    """case_id, series_id, season, y, n_train, pos, split, step."""
    from pyspark.sql import Window as W

    day = F.datediff(F.col("t"), F.lit("1970-01-01").cast("date"))

    def shape(df, case, series, season, t, y="y"):
        return df.select(
            F.lit(case).alias("case_id"), series.alias("series_id"), F.lit(season).alias("season"), t.alias("t"), F.col(y).alias("y")
        )

    c2 = weekly(spark, sf).groupBy("r_name", "wk").agg(F.sum("y").alias("y"))
    c3 = (
        read(spark, sf, "lineitem")
        .groupBy(days("l_shipdate").alias("t"))
        .agg((money_sum("l_quantity") / F.count("l_quantity")).alias("y"))
    )
    c4 = monthly(spark, sf).groupBy("p_type", "t").agg(F.sum("y").alias("y"))
    rows = (
        shape(daily(spark, sf), "case1", F.col("series_id"), 7, day)
        .unionByName(shape(c2, "case2", F.col("r_name"), 4, F.col("wk")))
        .unionByName(shape(c3, "case3", F.lit("all"), 7, day))
        .unionByName(shape(c4, "case4", F.col("p_type"), 12, day))
    )
    w = W.partitionBy("case_id", "series_id")
    placed = rows.select(
        "case_id",
        "series_id",
        "season",
        "y",
        F.floor(F.count("*").over(w) * 0.8).cast("int").alias("n_train"),
        (F.row_number().over(w.orderBy("t")) - 1).cast("int").alias("pos"),
    )
    test = F.col("pos") >= F.col("n_train")
    return placed.select(
        "*",
        F.when(test, "test").otherwise("train").alias("split"),
        F.when(test, F.col("pos") - F.col("n_train") + 1).alias("step"),
    )


# Test predictions of three models that SQL can reproduce.
PREDICTIONS = f"""(WITH s AS (SELECT * FROM {SERIES} z)
  SELECT e.case_id, e.series_id, e.step, e.y AS y_true, 'Naive' AS model, l.y AS y_pred
  FROM s e JOIN s l ON e.case_id = l.case_id AND e.series_id = l.series_id AND l.pos = e.n_train - 1
  WHERE e.split = 'test'
  UNION ALL SELECT e.case_id, e.series_id, e.step, e.y, 'SeasonalNaive', l.y
  FROM s e JOIN s l ON e.case_id = l.case_id AND e.series_id = l.series_id
    AND l.pos = e.n_train - e.season + (e.step - 1) % e.season
  WHERE e.split = 'test'
  UNION ALL SELECT e.case_id, e.series_id, e.step, e.y, 'LinearRegression', f.a + f.b * e.pos
  FROM s e JOIN (SELECT case_id, series_id, regr_slope(y, pos) AS b, regr_intercept(y, pos) AS a
    FROM s WHERE split = 'train' GROUP BY 1, 2) f USING (case_id, series_id)
  WHERE e.split = 'test')"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """case_id, series_id, step, y_true, model, y_pred."""
    from tidecast.models.forecast import last_value_forecast, seasonal_forecast
    from tidecast.operators.aggregate import simple_regression

    s = materialise(all_series(spark, sf), "series")
    keys = ["case_id", "series_id"]
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    far = {row["season"]: row["h"] for row in test.groupBy("season").agg(F.max("step").alias("h")).collect()}
    frames = []
    actual = test.select(*keys, "step", F.col("y").alias("y_true"), "pos")
    naive = last_value_forecast(train, keys, "pos", "y", max(far.values()))
    frames.append(actual.join(naive, [*keys, "step"]).withColumn("model", F.lit("Naive")))
    for season, horizon in far.items():
        part = train.where(F.col("season") == season)
        seasonal = seasonal_forecast(part, keys, "pos", "y", season, horizon)
        frames.append(actual.join(seasonal, [*keys, "step"]).withColumn("model", F.lit("SeasonalNaive")))
    line = simple_regression(train, "y", "pos", keys)
    frames.append(
        lookup_join(actual, line, keys, "inner")
        .withColumn("y_pred", F.col("intercept") + F.col("slope") * F.col("pos"))
        .withColumn("model", F.lit("LinearRegression"))
    )
    cols = [*keys, "step", "y_true", "model", "y_pred"]
    out = frames[0].select(*cols)
    for f in frames[1:]:
        out = out.unionByName(f.select(*cols))
    return out


RESULTS = f"""(SELECT case_id, model, 'test' AS split, avg(abs(y_true - y_pred)) AS mae,
  sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse,
  100 * avg(CASE WHEN abs(y_true) > 1e-10 THEN abs((y_true - y_pred) / y_true) END) AS mape,
  1 - sum((y_true - y_pred) * (y_true - y_pred)) / nullif(var_pop(y_true) * count(*), 0) AS r2,
  sqrt(avg(pow(ln(1 + greatest(y_true, 0)) - ln(1 + greatest(y_pred, 0)), 2))) AS rmsle,
  count(*) AS n FROM {PREDICTIONS} p GROUP BY 1, 2)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    """case_id, model, split, mae, rmse, mape, r2, rmsle, n."""
    from tidecast.operators.evaluate import score

    return score(predictions(spark, sf).withColumn("split", F.lit("test")), ["case_id", "model", "split"])
