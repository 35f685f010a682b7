"""A: sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.text import parse_number, parse_timestamp
from tidecast.models import regress
from tidecast.operators.joins import union_all
from tidecast.queries.registry import F1, PREDICTIONS, RESULTS, daily, predictions, query, r, read, results, rounded
from tidecast.schemas import DAILY_SERIES, require_columns
from tidecast.session import fresh_path, keep
from tidecast.sources import models as saved
from tidecast.sources import tables


@query(
    "a01_csv_scan",
    """SELECT o_orderkey, cast(cast(o_orderdate AS date) AS varchar) AS t,
       round(o_totalprice, 2) AS y FROM orders""",
)
def csv_scan(spark, sf):
    path = fresh_path(spark, "case1")
    source = read(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("Product_Code"),
        F.lit("W").alias("Warehouse"),
        F.col("o_orderpriority").alias("Product_Category"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("Date"),
        F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" ")).alias("Order_Demand"),
    )
    tables.write_csv(source, path)
    scanned = tables.load_case(spark, path, DAILY_SERIES)
    return scanned.select(
        F.col("Product_Code").cast("long").alias("o_orderkey"),
        F.to_date(parse_timestamp(F.col("Date"))).cast("string").alias("t"),
        r(parse_number(F.col("Order_Demand")), 2).alias("y"),
    )


@query(
    "a02_encoding_fallback",
    """SELECT encoding, doc_id, md5(text) AS h FROM documents,
       (VALUES ('UTF-8'), ('ISO-8859-1')) e(encoding)""",
)
def encoding_fallback(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    parts = []
    for encoding in ("UTF-8", "ISO-8859-1"):
        path = fresh_path(spark, "encoded")
        tables.write_csv(docs, path, encoding)
        found = tables.choose_encoding(spark, path)
        back = tables.read_csv(spark, path, docs.schema, found, line_breaks=True)
        parts.append(back.select(F.lit(found).alias("encoding"), "doc_id", F.md5(F.encode("text", "UTF-8")).alias("h")))
    return union_all(parts)


@query("a03_strip_bom", "SELECT c_custkey, c_mktsegment, c_nationkey FROM customer")
def strip_bom(spark, sf):
    raw = read(spark, sf, "customer").select(
        F.col("c_custkey").alias("\ufeffc_custkey"),
        F.col("c_mktsegment").alias("\u00ef\u00bb\u00bfc_mktsegment"),
        "c_nationkey",
    )
    return tables.clean_columns(raw)


@query(
    "a04_read_by_format",
    """SELECT fmt, p_partkey, p_name, round(p_retailprice, 2) AS p_retailprice FROM part,
       (VALUES ('csv'), ('parquet')) f(fmt)""",
)
def read_by_format(spark, sf):
    part = read(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    out = []
    for fmt in ("csv", "parquet"):
        path = f"{fresh_path(spark, 'part')}.{fmt}"
        tables.write_table(part, path)
        back = tables.read_table(spark, path, schema=part.schema)
        out.append(rounded(back, 2).withColumn("fmt", F.lit(fmt)))
    return union_all(out)


@query(
    "a05_write_by_format",
    """SELECT fmt, c_mktsegment, count(*) AS n FROM customer, (VALUES ('csv'), ('parquet')) f(fmt)
       GROUP BY 1, 2""",
)
def write_by_format(spark, sf):
    df = read(spark, sf, "customer")
    out = []
    for fmt in ("csv", "parquet"):
        path = fresh_path(spark, "customer")
        tables.write_table(df, path, fmt)
        back = spark.read.format(fmt).options(**(tables.CSV_OPTIONS if fmt == "csv" else {})).load(path)
        out.append(back.groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("fmt", F.lit(fmt)))
    return union_all(out)


@query(
    "a06_target_check",
    """SELECT 'orders' AS tbl, 'ok' AS status, count(o_totalprice) AS n FROM orders
       UNION ALL SELECT 'lineitem', 'missing', count(*) FROM lineitem""",
)
def target_check(spark, sf):
    rows = []
    for name in ("orders", "lineitem"):
        df = read(spark, sf, name)
        try:
            rows.append((name, "ok", require_columns(df, ["o_totalprice"]).agg(F.count("o_totalprice").alias("n"))))
        except ValueError:
            rows.append((name, "missing", df.agg(F.count("*").alias("n"))))
    return union_all([df.select(F.lit(n).alias("tbl"), F.lit(s).alias("status"), "n") for n, s, df in rows])


@query(
    "a07_named_tables",
    """SELECT 'customer' AS tbl, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders
       UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events""",
)
def named_tables(spark, sf):
    names = ("customer", "orders", "lineitem", "events")
    tables.register({f"tidecast_{n}": read(spark, sf, n) for n in names})
    return union_all([spark.table(f"tidecast_{n}").agg(F.count("*").alias("n")).withColumn("tbl", F.lit(n)) for n in names])


RESULT_SCHEMA = T.StructType(
    [T.StructField("model", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("mae", "rmse", "mape", "r2", "rmsle")]
)


@query(
    "a08_case_files",
    f"""SELECT case_id, model, round(mae, 3) + 0.0 AS mae, round(rmse, 3) + 0.0 AS rmse,
        CASE WHEN case_id = 'case2' THEN round(rmsle, 3) + 0.0 END AS rmsle FROM {RESULTS} x""",
)
def case_files(spark, sf):
    folder = fresh_path(spark, "results")
    rows = keep(results(spark, sf))
    for case in ("case1", "case2", "case3", "case4"):
        cols = ["model", "mae", "rmse", "mape", "r2"] + (["rmsle"] if case == "case2" else [])
        tables.write_csv(rows.where(F.col("case_id") == case).select(*cols), f"{folder}/{case}_results.csv")
    rows.unpersist()
    back = tables.scan_case_files(spark, folder, r"(case\d+)_results", RESULT_SCHEMA)
    return rounded(back.select("case_id", "model", "mae", "rmse", "rmsle"), 3)


@query(
    "a09_result_csv",
    f"SELECT case_id, model, round(mae, 3) + 0.0 AS mae, round(r2, 4) + 0.0 AS r2 FROM {RESULTS} x",
)
def result_csv(spark, sf):
    path = fresh_path(spark, "all-results")
    rows = results(spark, sf).select("case_id", "model", "mae", "r2")
    tables.write_csv(rows, path)
    back = tables.read_csv(spark, path, rows.schema, "UTF-8")
    return back.select("case_id", "model", r("mae", 3).alias("mae"), r("r2", 4).alias("r2"))


@query(
    "a10_prediction_files",
    f"SELECT case_id, model, series_id, step, round(y_true, 3) + 0.0 AS y_true, round(y_pred, 3) + 0.0 AS y_pred FROM {PREDICTIONS} x",
)
def prediction_files(spark, sf):
    path = fresh_path(spark, "predictions")
    tables.write_predictions(predictions(spark, sf), path)
    return rounded(spark.read.parquet(path), 3)


@query(
    "a11_summary_json",
    f"""SELECT case_id, arg_min(model, rmse) AS model, round(min(rmse), 3) + 0.0 AS rmse,
        (SELECT count(*) FROM {RESULTS} n) AS n_results FROM {RESULTS} b GROUP BY 1""",
)
def summary_json(spark, sf):
    path = fresh_path(spark, "summary")
    one = tables.summary_row(results(spark, sf), "2000-01-01T00:00:00")
    tables.write_json(one, path)
    back = spark.read.schema(one.schema).json(path)
    return back.select("n_results", F.explode("best").alias("b")).select(
        "n_results", "b.case_id", "b.model", r("b.rmse", 3).alias("rmse")
    )


def daily_line(spark, sf):
    """Daily totals with their day number as the only feature."""
    return daily(spark, sf).select("t", "y", F.datediff("t", F.lit("1995-01-01").cast("date")).cast("double").alias("x"))


LINE = f"(SELECT t, y, cast(date_diff('day', DATE '1995-01-01', t) AS double) AS x FROM {F1} s)"


@query(
    "a12_saved_model",
    f"""SELECT cast(t AS varchar) AS t, round(a + b * x, 2) + 0.0 AS y_pred FROM {LINE} d,
        (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM {LINE} e) f""",
)
def saved_model(spark, sf):
    rows = daily_line(spark, sf)
    path = fresh_path(spark, "model")
    saved.save_model(regress.fit(rows, ["x"], regress.linear("y")), path)
    scored = regress.predict(saved.load_model(path), rows)
    return scored.select(F.col("t").cast("string").alias("t"), r("y_pred", 2).alias("y_pred"))


@query("a13_model_configurations")
def model_configurations(spark, sf):
    rows = keep(daily_line(spark, sf))
    models = {
        ("case1", "LinearRegression"): regress.fit(rows, ["x"], regress.linear("y")),
        ("case1", "RandomForest"): regress.fit(rows, ["x"], regress.forest("y", numTrees=5, maxDepth=4)),
    }
    rows.unpersist()
    return saved.model_configurations(spark, models)
