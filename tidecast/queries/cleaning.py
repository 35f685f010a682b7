"""C: cleaning and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.functions.ratios import clip_zero
from tidecast.functions.text import ordinal, parse_number, parse_timestamp
from tidecast.operators import clean
from tidecast.operators.joins import union_all
from tidecast.operators.split import random_split
from tidecast.queries.projections import GAPS, with_gaps
from tidecast.queries.registry import query, r, read, rounded, split_sql


@query(
    "c01_impute_numeric",
    f"""SELECT o_orderkey, round(coalesce(price, med), 4) + 0.0 AS by_median, round(coalesce(price, mean), 4) + 0.0 AS by_mean,
        round(coalesce(price, 0), 4) + 0.0 AS by_zero
        FROM {GAPS} a, (SELECT quantile_cont(price, 0.5) AS med, avg(price) AS mean FROM {GAPS} b) f""",
)
def impute_numeric(spark, sf):
    df = with_gaps(spark, sf)
    out = df
    for strategy in ("median", "mean", "zero"):
        fill = clean.fit_imputer(df, ["price"], strategy)
        out = clean.apply_imputer(out.withColumn(f"by_{strategy}", F.col("price")), {f"by_{strategy}": fill["price"]})
    return rounded(out.select("o_orderkey", "by_median", "by_mean", "by_zero"), 4)


@query("c02_impute_category", f"SELECT o_orderkey, coalesce(priority, 'Unknown') AS priority FROM {GAPS} a")
def impute_category(spark, sf):
    return clean.fill_unknown(with_gaps(spark, sf)).select("o_orderkey", "priority")


@query(
    "c03_winsorise",
    """SELECT o_orderkey, round(greatest(least(o_totalprice, hi), lo), 4) + 0.0 AS price FROM orders,
       (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders) q""",
)
def winsorise(spark, sf):
    df = read(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    return rounded(clean.apply_winsor(df, clean.fit_winsor(df, ["price"])), 4)


@query("c04_clip_zero", "SELECT c_custkey, round(greatest(c_acctbal - 3000, 0), 4) + 0.0 AS balance FROM customer")
def clip(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", r(clip_zero(F.col("c_acctbal") - 3000), 4).alias("balance"))


def dirty_number(price, key):
    text = price.cast("decimal(18,2)").cast("string")
    return (
        F.when(key % 5 == 0, F.concat(F.lit("("), text, F.lit(")")))
        .when(key % 5 == 1, F.concat(F.lit(" $"), text, F.lit(" ")))
        .when(key % 5 == 2, F.concat(F.lit("-"), text))
        .when(key % 5 == 3, F.concat(text, F.lit("-1")))
        .otherwise(F.lit("n/a"))
    )


@query(
    "c05_parse_number",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice WHEN 2 THEN -o_totalprice END AS plain,
       CASE o_orderkey % 5 WHEN 0 THEN -o_totalprice WHEN 1 THEN o_totalprice WHEN 2 THEN -o_totalprice END AS accounting FROM orders""",
)
def parse_numbers(spark, sf):
    text = dirty_number(F.col("o_totalprice"), F.col("o_orderkey"))
    return read(spark, sf, "orders").select(
        "o_orderkey", parse_number(text).alias("plain"), parse_number(text, accounting_negative=True).alias("accounting")
    )


@query(
    "c06_parse_date",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN cast(cast(o_orderdate AS date) AS varchar) END AS t FROM orders""",
)
def parse_dates(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(k % 4 == 0, F.date_format(d, "M/d/yyyy"))
        .when(k % 4 == 1, F.date_format(d, "M/d/yyyy H:mm"))
        .when(k % 4 == 2, F.date_format(d, "yyyy-MM-dd"))
        .otherwise(F.lit("13/45/2011"))
    )
    return read(spark, sf, "orders").select("o_orderkey", F.to_date(parse_timestamp(text)).cast("string").alias("t"))


@query(
    "c07_standardise",
    f"""SELECT c_custkey, round((c_acctbal - m) / s, 6) + 0.0 AS c_acctbal, round((c_nationkey - m2) / s2, 6) + 0.0 AS c_nationkey
        FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, avg(c_nationkey) AS m2, stddev_pop(c_nationkey) AS s2
        FROM customer WHERE {split_sql('c_custkey')} = 'train') f""",
)
def standardise(spark, sf):
    df = random_split(read(spark, sf, "customer"), ["c_custkey"])
    scaler = clean.fit_scaler(df.where("split = 'train'"), ["c_acctbal", "c_nationkey"])
    return rounded(clean.apply_scaler(df, scaler).select("c_custkey", "c_acctbal", "c_nationkey"))


ORDER_SPLIT = f"(SELECT *, {split_sql('o_orderkey')} AS split FROM orders)"


def split_orders(spark, sf):
    return random_split(read(spark, sf, "orders"), ["o_orderkey"])


@query(
    "c08_target_encoding",
    f"""SELECT o_orderkey, round(coalesce(m, g), 4) + 0.0 AS o_custkey_encoded FROM orders
        LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS m FROM {ORDER_SPLIT} a WHERE split = 'train' GROUP BY 1) e USING (o_custkey),
        (SELECT avg(o_totalprice) AS g FROM {ORDER_SPLIT} b WHERE split = 'train') f""",
)
def target_encoding(spark, sf):
    df = split_orders(spark, sf)
    fitted = clean.fit_target_encoding(df.where("split = 'train'"), "o_custkey", "o_totalprice")
    return rounded(clean.apply_target_encoding(df, "o_custkey", fitted).select("o_orderkey", "o_custkey_encoded"), 4)


@query(
    "c09_one_hot",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS "o_orderstatus_O",
       CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS "o_orderstatus_P",
       CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS "o_orderpriority_2-HIGH",
       CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END AS "o_orderpriority_3-MEDIUM",
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS "o_orderpriority_4-NOT SPECIFIED",
       CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS "o_orderpriority_5-LOW" FROM orders""",
)
def one_hot(spark, sf):
    df = split_orders(spark, sf)
    categories = clean.fit_one_hot(df.where("split = 'train'"), ["o_orderstatus", "o_orderpriority"])
    return clean.apply_one_hot(df.select("o_orderkey", "o_orderstatus", "o_orderpriority"), categories)


@query(
    "c10_common_columns",
    """SELECT side, count(*) AS n, sum(CASE WHEN p = '5-LOW' THEN 1 ELSE 0 END) AS low FROM
       (SELECT CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END AS side,
        CASE WHEN o_orderstatus = 'F' OR o_orderpriority IN ('1-URGENT', '5-LOW') THEN o_orderpriority ELSE '1-URGENT' END AS p FROM orders) t GROUP BY 1""",
)
def common_columns(spark, sf):
    orders = read(spark, sf, "orders")
    sides = {
        "a": orders.where("o_orderstatus = 'F'"),
        # The other side has two priorities only.
        "b": orders.where("o_orderstatus <> 'F'").withColumn(
            "o_orderpriority", F.when(F.col("o_orderpriority") == "5-LOW", "5-LOW").otherwise("1-URGENT")
        ),
    }
    hot = {k: clean.apply_one_hot(d, clean.fit_one_hot(d, ["o_orderpriority"])) for k, d in sides.items()}
    shared = clean.common_columns(*hot.values())
    flags = [c for c in shared if c.startswith("o_orderpriority_")]
    return union_all(
        [
            d.select(*shared).agg(F.count("*").alias("n"), *[F.sum(f"`{c}`").alias(c.split("-")[-1].lower()) for c in flags]).withColumn("side", F.lit(k))
            for k, d in hot.items()
        ]
    )


@query("c11_native_categories", "SELECT c_custkey, cast(c_nationkey AS varchar) AS c_nationkey, c_mktsegment FROM customer")
def native_categories(spark, sf):
    df = read(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return clean.native_categories(df, ["c_nationkey", "c_mktsegment"])


@query(
    "c12_ordinal",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 3 ELSE 2 END AS rank FROM orders""",
)
def ordinal_map(spark, sf):
    ranks = {"1-URGENT": 0, "2-HIGH": 1, "5-LOW": 3}
    return read(spark, sf, "orders").select("o_orderkey", ordinal(F.col("o_orderpriority"), ranks, 2).alias("rank"))


def _narrow_sql(c: str) -> str:
    return f"""SELECT '{c}' AS name, CASE WHEN min({c}) > -128 AND max({c}) < 127 THEN 'tinyint'
      WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'smallint'
      WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE 'bigint' END AS type FROM lineitem"""


@query(
    "c13_narrow_types",
    " UNION ALL ".join(_narrow_sql(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    + " UNION ALL SELECT name, 'float' FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) v(name)",
)
def narrow(spark, sf):
    _, chosen = clean.narrow_types(read(spark, sf, "lineitem"))
    return spark.createDataFrame(sorted(chosen.items()), "name string, type string")
