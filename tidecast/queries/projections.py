"""B: projections, filters, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.functions.text import slug, slug_column
from tidecast.operators.clean import numeric_columns
from tidecast.operators.evaluate import deny_list_violations
from tidecast.operators.joins import union_all
from tidecast.operators.reshape import ordered_columns
from tidecast.operators.split import range_split
from tidecast.queries.registry import F2, F3, LINE_KEY, lines, query, read, weekly
from tidecast.schemas import Case, allowed_columns, feature_columns

# Policy of the cross-section test table.
LINES = Case(
    name="lines",
    target="l_quantity",
    time="o_orderdate",
    approved=("l_discount", "l_tax", "p_retailprice", "p_size", "c_acctbal", "o_orderpriority", "n_name", "not_there"),
    optional=("c_mktsegment", "p_type"),
    denied=("l_returnflag", "l_linestatus", "l_shipdate", "leak"),
)


@query(
    "b01_allow_list",
    f"""SELECT l_quantity, l_discount, l_tax, p_retailprice, p_size, c_acctbal, o_orderpriority, n_name,
        c_mktsegment, p_type FROM {F3} x""",
)
def allow_list(spark, sf):
    df = lines(spark, sf)
    return df.select(*allowed_columns(df, LINES))


@query(
    "b02_deny_list",
    f"""SELECT name, count(*) AS n FROM {F3} x, (VALUES ('l_returnflag'), ('l_linestatus'), ('l_shipdate'), ('leak')) d(name)
        GROUP BY 1""",
)
def deny_list(spark, sf):
    df = lines(spark, sf)
    found = deny_list_violations(df, list(LINES.denied))
    return df.select(F.explode(F.array(*[F.lit(c) for c in found])).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("b03_drop_columns", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def drop_columns(spark, sf):
    return read(spark, sf, "customer").drop("c_name", "c_acctbal", "not_there")


GAPS = """(SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS price,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS priority FROM orders)"""


def with_gaps(spark, sf):
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k % 17 != 0, F.col("o_totalprice")).alias("price"),
        F.when(k % 13 != 0, F.col("o_orderpriority")).alias("priority"),
    )


@query(
    "b04_drop_missing",
    f"""SELECT 'any' AS rule, o_orderkey FROM {GAPS} a WHERE price IS NOT NULL AND priority IS NOT NULL
        UNION ALL SELECT 'price', o_orderkey FROM {GAPS} b WHERE price IS NOT NULL""",
)
def drop_missing(spark, sf):
    df = with_gaps(spark, sf)
    return union_all(
        [
            df.dropna().select(F.lit("any").alias("rule"), "o_orderkey"),
            df.dropna(subset=["price"]).select(F.lit("price").alias("rule"), "o_orderkey"),
        ]
    )


RANGES = {"train": (1, 237), "val": (238, 296), "test": (297, 344)}
RANGE_SQL = """CASE WHEN wk BETWEEN 1 AND 237 THEN 'train' WHEN wk BETWEEN 238 AND 296 THEN 'val'
  WHEN wk BETWEEN 297 AND 344 THEN 'test' END"""


@query("b05_week_ranges", f"SELECT r_name, c_mktsegment, wk, y, {RANGE_SQL} AS split FROM {F2} x")
def week_ranges(spark, sf):
    return range_split(weekly(spark, sf), "wk", RANGES).select("r_name", "c_mktsegment", "wk", "y", "split")


@query(
    "b06_known_and_horizon",
    f"SELECT CASE WHEN wk <= 296 THEN 'known' ELSE 'horizon' END AS part, count(*) AS n, sum(y) AS y FROM {F2} x GROUP BY 1",
)
def known_and_horizon(spark, sf):
    df = weekly(spark, sf)
    parts = {"known": df.where("wk <= 296"), "horizon": df.where("wk > 296")}
    return union_all(
        [d.agg(F.count("*").alias("n"), F.sum("y").alias("y")).withColumn("part", F.lit(p)) for p, d in parts.items()]
    )


@query("b07_numeric_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def numeric_only(spark, sf):
    df = read(spark, sf, "orders")
    return df.select(*numeric_columns(df))


@query(
    "b08_feature_list",
    "SELECT l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem",
)
def feature_list(spark, sf):
    df = read(spark, sf, "lineitem")
    return df.select(*feature_columns(df, ["l_quantity", "l_shipdate", *LINE_KEY]))


@query("b09_column_order", "SELECT c_mktsegment, c_nationkey, c_custkey, c_name, c_acctbal FROM customer")
def column_order(spark, sf):
    return ordered_columns(read(spark, sf, "customer"), ["c_mktsegment", "not_there", "c_nationkey"])


@query(
    "b10_membership",
    """SELECT o_orderkey, CASE WHEN isodow(o_orderdate) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS is_expedited FROM orders""",
)
def membership(spark, sf):
    return read(spark, sf, "orders").select(
        "o_orderkey",
        F.weekday("o_orderdate").isin(5, 6).cast("int").alias("is_weekend"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("is_expedited"),
    )


@query(
    "b11_slug",
    """SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' (' || p_type || '/X)'), '[ /]', '_', 'g'), '[()]', '', 'g') AS code
       FROM part""",
)
def slugs(spark, sf):
    label = F.concat("p_name", F.lit(" ("), "p_type", F.lit("/X)"))
    df = read(spark, sf, "part").select("p_partkey", slug_column(label).alias("Code ()"))
    return df.toDF(*[slug(c).strip("_") for c in df.columns])
