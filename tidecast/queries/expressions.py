"""I: scalar functions and feature expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.functions import calendar as cal
from tidecast.functions import ratios
from tidecast.queries.registry import F1, F2, F4, daily, monthly, query, read, rounded, weekly

PANEL = ["r_name", "c_mktsegment", "wk"]
ENTITY = ["s_nationkey", "p_type", "t"]


def named(columns):
    return [c.alias(n) for n, c in columns.items()]


def cyc_sql(expr: str, period: int, name: str) -> str:
    return f"""round(sin(2 * pi() * ({expr}) / {period}), 6) + 0.0 AS {name}_sin, round(cos(2 * pi() * ({expr}) / {period}), 6) + 0.0 AS {name}_cos"""


CALENDAR_SQL = """cast(month({t}) AS int) AS month, cast(isodow({t}) - 1 AS int) AS day_of_week, cast(week({t}) AS int) AS week_of_year,
  cast(quarter({t}) AS int) AS quarter, CASE WHEN isodow({t}) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN day({t}) = 1 THEN 1 ELSE 0 END AS is_month_start, CASE WHEN cast({t} AS date) = last_day({t}) THEN 1 ELSE 0 END AS is_month_end"""


@query("i01_calendar", f"SELECT o_orderkey, {CALENDAR_SQL.format(t='o_orderdate')} FROM orders")
def calendar(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", *named(cal.calendar_columns("o_orderdate")))


@query(
    "i02_order_time",
    """SELECT event_id, event_type, cast(month(ts) AS int) AS order_month, cast(isodow(ts) - 1 AS int) AS order_dayofweek, cast(week(ts) AS int) AS order_weekofyear FROM events""",
)
def order_time(spark, sf):
    df = read(spark, sf, "events").select("event_id", "event_type", "ts")
    return df.withColumns(cal.order_time_columns("ts")).drop("ts")


@query(
    "i03_cyclical",
    f"SELECT o_orderkey, {cyc_sql('month(o_orderdate)', 12, 'month')}, {cyc_sql('isodow(o_orderdate) - 1', 7, 'day_of_week')} FROM orders",
)
def cyclical(spark, sf):
    t = F.col("o_orderdate")
    cols = {**cal.cyclical(F.month(t), 12, "month"), **cal.cyclical(F.weekday(t), 7, "day_of_week")}
    return rounded(read(spark, sf, "orders").select("o_orderkey", *named(cols)))


@query(
    "i04_week_parts",
    f"""SELECT r_name, c_mktsegment, wk, cast((wk - 1) // 13 + 1 AS int) AS quarter, cast((wk - 1) // 52 + 1 AS int) AS year,
        cast((wk - 1) % 52 + 1 AS int) AS week_in_year FROM {F2} x""",
)
def week_parts(spark, sf):
    return weekly(spark, sf).select(*PANEL, *named(cal.week_columns(F.col("wk"))))


@query(
    "i05_log_features",
    """SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) + 0.0 AS log_balance,
       round(greatest(exp(c_nationkey / 10.0) - 1, 0), 6) + 0.0 AS units FROM customer""",
)
def log_features(spark, sf):
    df = read(spark, sf, "customer").select(
        "c_custkey",
        ratios.log1p_clipped(F.col("c_acctbal")).alias("log_balance"),
        ratios.expm1_clipped(F.col("c_nationkey") / 10).alias("units"),
    )
    return rounded(df)


@query(
    "i06_price_ratio",
    f"SELECT r_name, c_mktsegment, wk, round(coalesce(checkout_price / nullif(base_price, 0), 0), 6) + 0.0 AS price_ratio FROM {F2} x",
)
def price_ratio(spark, sf):
    df = weekly(spark, sf)
    return rounded(df.select(*PANEL, ratios.safe_ratio(F.col("checkout_price"), F.col("base_price")).alias("price_ratio")))


@query(
    "i07_discounts",
    f"""SELECT r_name, c_mktsegment, wk, round(base_price - checkout_price, 4) + 0.0 AS discount_amount,
        round((base_price - checkout_price) / CASE WHEN base_price = 0 THEN 1 ELSE base_price END * 100, 4) + 0.0 AS discount_percent,
        CASE WHEN base_price - checkout_price > 0 THEN 1 ELSE 0 END AS discount_yn FROM {F2} x""",
)
def discounts(spark, sf):
    cols = ratios.discount_columns(F.col("base_price"), F.col("checkout_price"))
    return rounded(weekly(spark, sf).select(*PANEL, *named(cols)), 4)


@query(
    "i08_promotions",
    f"""SELECT r_name, c_mktsegment, wk, emailer + homepage AS promo_count, emailer * homepage AS both_promo,
        round((emailer + homepage) * ((base_price - checkout_price) / CASE WHEN base_price = 0 THEN 1 ELSE base_price END * 100), 4) + 0.0 AS promo_discount_interaction FROM {F2} x""",
)
def promotions(spark, sf):
    pct = ratios.discount_columns(F.col("base_price"), F.col("checkout_price"))["discount_percent"]
    cols = ratios.promotion_columns(F.col("emailer"), F.col("homepage"), pct)
    return rounded(weekly(spark, sf).select(*PANEL, *named(cols)), 4)


@query(
    "i09_order_values",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(l_extendedprice / nullif(l_quantity, 0), 0), 4) + 0.0 AS order_value_per_unit,
       round(coalesce(l_extendedprice * (1 - l_discount) / nullif(l_quantity, 0), 0), 4) + 0.0 AS sales_per_item,
       round(coalesce(l_discount / nullif(l_quantity, 0), 0), 4) + 0.0 AS discount_per_item,
       round(coalesce(l_discount / nullif(l_extendedprice, 0), 0), 4) + 0.0 AS discount_to_total,
       round(coalesce(l_extendedprice * (1 - l_discount) / nullif(l_extendedprice, 0), 0), 4) + 0.0 AS sales_to_total FROM lineitem""",
)
def order_values(spark, sf):
    price, disc = F.col("l_extendedprice"), F.col("l_discount")
    cols = ratios.order_value_columns(F.col("l_quantity"), price, price * (1 - disc), disc)
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *named(cols))
    return rounded(df, 4)


@query(
    "i10_competitor",
    f"""SELECT s_nationkey, p_type, cast(t AS varchar) AS t, round(price / CASE WHEN competitor = 0 THEN 1 ELSE competitor END, 6) + 0.0 AS price_ratio,
        round(price - competitor, 6) + 0.0 AS price_gap, round(price * (1 - discount / 100), 6) + 0.0 AS price_after_discount,
        round(price * (discount / 100), 6) + 0.0 AS discount_amount FROM {F4} x""",
)
def competitor(spark, sf):
    cols = ratios.competitor_columns(F.col("price"), F.col("competitor"), F.col("discount"))
    return rounded(monthly(spark, sf).select(*ENTITY, *named(cols)))


@query(
    "i11_inventory",
    f"""SELECT s_nationkey, p_type, cast(t AS varchar) AS t, round(coalesce(y / nullif(inventory, 0), 0), 6) + 0.0 AS inventory_to_order_ratio,
        round(inventory - y, 6) + 0.0 AS inventory_buffer FROM {F4} x""",
)
def inventory(spark, sf):
    cols = ratios.inventory_columns(F.col("inventory"), F.col("y"))
    return rounded(monthly(spark, sf).select(*ENTITY, *named(cols)))


@query(
    "i12_harmonics",
    f"""SELECT pos, cast(pos AS double) AS x_t, round(sin(2 * pi() * pos / 7), 6) + 0.0 AS x_sin, round(cos(2 * pi() * pos / 7), 6) + 0.0 AS x_cos
        FROM (SELECT cast(unnest(generate_series(0, (SELECT count(*) FROM {F1} x) + 27)) AS int) AS pos) z""",
)
def harmonics(spark, sf):
    n = daily(spark, sf).agg(F.count("*").alias("n"))
    pos = n.select(F.explode(F.sequence(F.lit(0), (F.col("n") + 27).cast("int"))).alias("pos"))
    return rounded(pos.select("pos", *named(cal.harmonics(F.col("pos")))))


@query(
    "i13_whole_units",
    f"SELECT r_name, c_mktsegment, wk, cast(floor(greatest(exp(ln(1 + y) * 0.97) - 1, 0)) AS bigint) AS units FROM {F2} x",
)
def whole_units(spark, sf):
    return weekly(spark, sf).select(*PANEL, ratios.to_count(F.log1p("y") * 0.97).alias("units"))
