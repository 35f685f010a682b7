"""Joins whose plan holds for hot keys and for lookup tables of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidecast.session import materialise

# A lookup table is broadcast only when it was measured and is no larger than this.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 2**20
# A table whose planner estimate is beyond this is not measured: it is too large to broadcast.
MEASURED_BYTES = 2**40
# A key is hot when it holds more than this share of the rows on the large side,
# so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.002
# Parts into which the rows of a hot key and the rows without a key are dealt.
SALTS = 64


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Measure rows and bytes of ``df`` by one aggregation, each time: a table may have grown at the same path."""
    if rows <= 0:
        return False
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(estimate) > MEASURED_BYTES:
        return False
    fixed, text = 0, []
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            text.append(F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            text.append(F.coalesce(F.octet_length(F.to_json(F.struct(f"`{f.name}`"))), F.lit(0)))
        else:
            fixed += 16
    width = sum(text, F.lit(fixed)).cast("long")
    count, size = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return count <= rows and size <= BROADCAST_BYTES


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE) -> list[tuple]:
    """Keys holding more than ``share`` of all rows, in one job; there are at most 1 / share.

    The roll-up adds one line with the number of all rows, always the largest count. Counts are
    combined on the map side, so a hot key is one row per task when it reaches the shuffle.
    """
    counts = (
        df.select(F.struct(*keys).alias("_k")).rollup("_k").agg(F.count("*").alias("_n"), F.grouping("_k").alias("_all"))
    )
    top = counts.orderBy(F.desc("_n"), F.desc("_all")).limit(int(1 / share) + 1).collect()
    total = sum(r["_n"] for r in top if r["_all"])
    return [tuple(r["_k"]) for r in top if not r["_all"] and r["_n"] > share * total]


def lookup_join(
    large: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
    hot: list[tuple] = (),
    computed: bool = False,
) -> DataFrame:
    """Join a large table to a lookup table that is unique on ``keys``.

    A lookup of counted, bounded size is broadcast. Beyond the bound the join shuffles each side
    once, on the keys and a salt. Rows with a null key match nothing and are dealt over all salts;
    so are the rows of the keys in ``hot``, whose lookup rows are written once per salt. Large keys
    that nobody named are split by adaptive execution. ``computed`` says that the lookup is itself
    the result of a job; it is then written once, so that counting it and joining it do not run
    that job twice.
    """
    if computed:
        lookup = materialise(lookup, "lookup")
    if fits_broadcast(lookup, broadcast_rows):
        return large.join(F.broadcast(lookup), keys, how)
    names = [F.col(f"`{k}`") for k in keys]
    hot = [k for k in hot if None not in k]
    kinds = [large.schema[k].dataType for k in keys]

    def is_hot() -> Column:
        rows = [F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(k, kinds, keys)]) for k in hot]
        return F.struct(*[c.alias(k) for c, k in zip(names, keys)]).isin(*rows) if hot else F.lit(False)

    missing = F.lit(False)
    for c in names:
        missing = missing | c.isNull()
    # From the row's own values, so that a task that runs again deals its rows alike.
    values = [F.col(f"`{f.name}`") for f in large.schema if not isinstance(f.dataType, T.MapType)]
    spread_ = F.pmod(F.xxhash64(*values), F.lit(SALTS))
    salted = large.withColumn("_salt", F.when(missing | is_hot(), spread_).otherwise(F.lit(0)).cast("int"))
    copies = F.when(is_hot(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    side = lookup.withColumn("_salt", F.explode(copies))
    return salted.join(side, [*keys, "_salt"], how).drop("_salt")


def lookup_with_default(
    df: DataFrame, mapping: DataFrame, key: str, value: str, default: Column | float, computed: bool = False
) -> DataFrame:
    """Left lookup of ``value``; rows without a match get ``default``."""
    fill = default if isinstance(default, Column) else F.lit(default)
    return lookup_join(df, mapping, [key], computed=computed).withColumn(value, F.coalesce(F.col(value), fill))


def select_rows(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is listed: a left semi join."""
    return lookup_join(df, ids.select(*keys).distinct(), keys, "left_semi", computed=True)


def align(actual: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Pair actual and predicted values on (series, period) rather than by position."""
    return actual.join(predicted, keys, "inner")


def with_benchmark(results: DataFrame, case: str, model: str, metric: str, name: str) -> DataFrame:
    """Attach the benchmark model's metric of the same case to every row of a result table.

    A window over the models of a case, so the result table is computed once.
    """
    bench = F.max(F.when(F.col(model) == name, F.col(metric))).over(W.partitionBy(case))
    return results.withColumn(f"{metric}_{name}", bench)


def coverage_gaps(results: DataFrame, case: str, model: str) -> DataFrame:
    """(case, model) pairs that have no result, without pairing every case with every model.

    Each case keeps the set of its models; ``array_except`` against the set of all models leaves
    the gaps. Both sets are as long as the list of models, and the full set is one row.
    """
    results = materialise(results.select(case, model).distinct(), "pairs")
    by_case = results.groupBy(case).agg(F.collect_set(model).alias("_have"))
    everything = results.agg(F.array_sort(F.collect_set(model)).alias("_all"))
    # One row, as long as the list of models.
    return by_case.join(F.broadcast(everything)).select(case, F.explode(F.array_except("_all", "_have")).alias(model))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
