"""Temporal, random and growing splits, and top-n selection.

A split by row fraction needs the row at one position of the sorted table, not a position for
every row. The position is found by counting: rows per date, then rows per hash prefix on the cut
date, then rows per hash within that prefix. Each row is then labelled by comparing its (date,
hash) with the cut, so no sort, no row number and no window over table rows takes place.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidecast.operators.joins import union_all
from tidecast.session import materialise

# Hash characters added per counting pass, and how many hashes are ordered at once.
PREFIX = 4
ORDERED_HASHES = 1_000_000
# Copies of one row written out per task step.
CHUNK = 100_000


def row_hash(key: list[str], seed: int = 42) -> Column:
    """Order-independent hash of the key columns; equal on every run and partitioning."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in key]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def random_split(df: DataFrame, key: list[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``split`` = train or test from the first 32 bits of the row hash. No shuffle."""
    if not 0 <= test_share < 1:
        raise ValueError("the test share is at least 0 and below 1")
    limit = f"{int(test_share * 2**32):08x}"
    return df.withColumn(
        "split", F.when(F.substring(row_hash(key, seed), 1, 8) < limit, "test").otherwise("train")
    )


def range_split(df: DataFrame, time: str, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Inclusive ranges of an integer period; rows outside all ranges have a null label."""
    label = F.lit(None).cast("string")
    for name, (low, high) in ranges.items():
        label = F.when(F.col(time).between(low, high), name).otherwise(label)
    return df.withColumn("split", label)


def _until(df: DataFrame, time: str, date: datetime.date) -> Column:
    """On or before a date, as a comparison of the plain column that a file scan can use."""
    if isinstance(df.schema[time].dataType, T.DateType):
        return F.col(time) <= F.lit(date)
    following = (date + datetime.timedelta(days=1)).isoformat()
    return F.col(time) < F.lit(following).cast(df.schema[time].dataType)


@dataclass(frozen=True)
class Cut:
    """First ``rows`` rows end inside the group of equal (date, hash) starting at ``start``."""

    rows: int
    date: datetime.date | None
    hash: str | None
    start: int
    copies: int


def _exact(df: DataFrame, column: str) -> Column:
    """A value as text that no other value of its type has; null for null. Nested values by a hash of all they hold."""
    value, kind = F.col(f"`{column}`"), df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, T.MapType):
        value = F.array_sort(F.map_entries(value))
    if isinstance(kind, (T.MapType, T.ArrayType, T.StructType)):
        return F.when(F.col(f"`{column}`").isNotNull(), F.concat(F.xxhash64(F.lit(1), value).cast("string"), F.lit(" "), F.xxhash64(F.lit(2), value).cast("string")))
    return value.cast("string")


def _place(df: DataFrame, key: list[str], seed: int) -> Column:
    """Order of the rows of one date: by key hash, rows that share a key by every value of the row."""
    parts = []
    for c in df.columns:
        text = _exact(df, c)
        # A value's length before it, so that no two rows read alike.
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("~")))
    return F.concat(row_hash(key, seed), F.md5(F.concat(*parts)))


def _reach(counts: DataFrame, order: str, rows: int) -> tuple:
    """The entry of an ordered count table that contains position ``rows`` - 1."""
    w = W.orderBy(F.asc_nulls_last(order)).rowsBetween(W.unboundedPreceding, 0)
    hit = (
        counts.withColumn("_end", F.sum("n").over(w))
        .where((F.col("_end") >= rows) & (F.col("_end") - F.col("n") < rows))
        .first()
    )
    if hit[order] is None:
        raise ValueError("the cut falls on rows without a date; drop those first")
    return hit[order], hit["_end"] - hit["n"], hit["n"]


def days_of(df: DataFrame, time: str) -> DataFrame:
    """Rows per date, written once: every cut of the table is placed on it."""
    return materialise(df.groupBy(F.to_date(time).alias("d")).agg(F.count("*").alias("n")), "dates")


def total(by_day: DataFrame) -> int:
    return by_day.agg(F.sum("n")).first()[0] or 0


def find_cuts(
    df: DataFrame, time: str, sizes: list[int], key: list[str], seed: int = 42, by_day: DataFrame | None = None
) -> list[Cut]:
    """Cut points after the given numbers of rows, in (date, hash) order.

    All cuts are found together: one job per level counts the prefixes, or in the end the hashes,
    of every date that holds a cut.
    """
    by_day = days_of(df, time) if by_day is None else by_day
    open_ = {}
    for rows in dict.fromkeys(sizes):
        if rows > 0:
            date, before, found = _reach(by_day, "d", rows)
            open_[rows] = (date, "", before, found)
    done = {rows: Cut(0, None, None, 0, 0) for rows in sizes if rows <= 0}
    place = _place(df, key, seed)

    def counted(level: int | None, picked: dict) -> DataFrame:
        inside = F.lit(False)
        for date, prefix, _, _ in picked.values():
            eve = date - datetime.timedelta(days=1)
            inside = inside | (_until(df, time, date) & ~_until(df, time, eve) & place.startswith(prefix))
        part = place if level is None else F.substring(place, 1, level)
        return materialise(df.where(inside).groupBy(F.to_date(time).alias("d"), part.alias("h")).agg(F.count("*").alias("n")), "hashes")

    level = 0
    while level < 64 and (deep := {r: o for r, o in open_.items() if o[3] > ORDERED_HASHES}):
        level += PREFIX
        counts = counted(level, deep)
        for rows, (date, prefix, before, _) in deep.items():
            here = counts.where((F.col("d") == F.lit(date)) & F.col("h").startswith(prefix))
            prefix, skipped, found = _reach(here, "h", rows - before)
            open_[rows] = (date, prefix, before + skipped, found)
    if open_:
        counts = counted(None, open_)
        for rows, (date, prefix, before, _) in open_.items():
            here = counts.where((F.col("d") == F.lit(date)) & F.col("h").startswith(prefix))
            hashed, skipped, copies = _reach(here, "h", rows - before)
            done[rows] = Cut(rows, date, hashed, before + skipped, copies)
    return [done[rows] for rows in sizes]


def segments(
    df: DataFrame, time: str, sizes: list[int], key: list[str], seed: int = 42, by_day: DataFrame | None = None
) -> DataFrame:
    """Add ``segment``: how many of the cuts lie at or before the row.

    Rows equal in date and hash are equal in every column. If a cut falls between such copies, that
    one group is counted and written out again in chunks, so that each side receives the exact
    number.
    """
    cuts = find_cuts(df, time, sizes, key, seed, by_day)
    day, h = F.to_date(time), _place(df, key, seed)
    at = F.lit(0)
    torn: dict[tuple, Cut] = {}
    for c in cuts:
        if c.date is None:
            at = at + 1
            continue
        after = (day > F.lit(c.date)) | ((day == F.lit(c.date)) & (h > F.lit(c.hash)))
        at = at + F.coalesce(after, F.lit(True)).cast("int")
        if c.start + c.copies > c.rows:
            torn[(c.date, c.hash)] = c
    if not torn:
        return df.withColumn("segment", at)
    inside = F.lit(False)
    parts = []
    for c in torn.values():
        same = F.coalesce((day == F.lit(c.date)) & (h == F.lit(c.hash)), F.lit(False))
        inside = inside | same
        chunks = (c.copies + CHUNK - 1) // CHUNK
        pos = F.col("_chunk") * CHUNK + F.col("_i")
        number = F.lit(0)
        for other in cuts:
            number = number + (F.lit(c.start) + pos >= other.rows).cast("int")
        parts.append(
            df.where(same)
            .limit(1)
            .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
            .repartition(min(chunks, 2000), "_chunk")
            .withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(min(CHUNK, c.copies) - 1))))
            .where(pos < c.copies)
            .withColumn("segment", number)
            .drop("_chunk", "_i")
        )
    return union_all([df.where(~inside).withColumn("segment", at), *parts])


def temporal_split(
    df: DataFrame,
    time: str,
    fraction: float = 0.8,
    whole_dates: bool = True,
    key: list[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """``split`` = train for the earliest ``fraction`` of the rows, test for the rest.

    ``whole_dates`` keeps each date on one side, the date of the cut with the training rows.
    Otherwise exactly ``int(n * fraction)`` rows are training rows.
    """
    if not whole_dates:
        by_day = days_of(df, time)
        done = segments(df, time, [int(total(by_day) * fraction)], key or df.columns, seed, by_day)
        return done.withColumn(
            "split", F.when(F.col("segment") == 0, "train").otherwise("test")
        ).drop("segment")
    by_day = days_of(df, time)
    n = total(by_day)
    if int(n * fraction) < 1:
        return df.withColumn("split", F.lit("test"))
    last, _, _ = _reach(by_day, "d", int(n * fraction))
    return df.withColumn("split", F.when(_until(df, time, last), "train").otherwise("test"))


def validation_tail(df: DataFrame, time: str, share: float = 0.2, key: list[str] | None = None) -> DataFrame:
    """Of the training rows, label the last ``share`` as validation; other rows keep their label."""
    train = df.where(F.col("split") == "train").drop("split")
    parts = temporal_split(train, time, 1 - share, whole_dates=False, key=key or train.columns)
    renamed = parts.withColumn("split", F.when(F.col("split") == "test", "val").otherwise("train"))
    return union_all([renamed.select(df.columns), df.where(F.col("split") != "train")])


def earliest(df: DataFrame, time: str, fraction: float = 0.3, key: list[str] | None = None) -> DataFrame:
    """The earliest ``fraction`` of the rows, at least one row."""
    by_day = days_of(df, time)
    rows = max(1, int(total(by_day) * fraction))
    return segments(df, time, [rows], key or df.columns, by_day=by_day).where("segment = 0").drop("segment")


def growing_prefixes(
    df: DataFrame, time: str, fractions: list[float], key: list[str] | None = None
) -> DataFrame:
    """Each row once per training size that includes it, in column ``size``."""
    by_day = days_of(df, time)
    n, ordered = total(by_day), sorted(fractions)
    placed = segments(df, time, [int(n * f) for f in ordered], key or df.columns, by_day=by_day)
    names = F.array(*[F.lit(float(f)) for f in ordered])
    remaining = F.slice(names, F.col("segment") + 1, F.lit(len(ordered)))
    return placed.withColumn("size", F.explode(remaining)).drop("segment")


def top_n(df: DataFrame, score: str, n: int, tiebreak: list[str] = ()) -> DataFrame:
    """Largest ``n`` rows by absolute score: each task keeps n rows, then one task merges them."""
    return df.orderBy(F.desc(F.abs(score)), *tiebreak).limit(n)


def top_n_by_group(df: DataFrame, keys: list[str], score: str, n: int, tiebreak: list[str]) -> DataFrame:
    """Largest ``n`` rows per group. The planner limits each group per task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(F.desc(score), *tiebreak)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
