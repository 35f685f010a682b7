"""Exact top-k search by inner product: term-at-a-time accumulation over blocks of rows.

A component is a term. Every block of rows keeps, per term, a postings list (the rows with a
non-zero weight, and the weights). A query scatters ``weight * posting weight`` of each of its own
non-zero terms into a dense array with one score per row of the block. A partition selects the
block's best, and the blocks' best are merged.

Queries and rows meet in a grid of blocks, dealt out by a hash of their identifiers, so neither
side is broadcast and no task holds more than ``ROW_BLOCK`` rows and ``QUERY_BLOCK`` queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import column, cores, to_batch

#: Rows and queries of a block.
ROW_BLOCK = 1024
QUERY_BLOCK = 512
#: Queries whose scores are held at once, so that the accumulator stays in cache.
STRIDE = 64

#: In place of an identifier where a query has fewer rows.
NONE = 2**63 - 1
_LIMIT = 2**63 - 1


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows with an identifier whose vector is neither null nor holds null, NaN or infinity."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))


def blocks(rows: DataFrame, count: int, name: str) -> DataFrame:
    """``rows`` (vec_id, v) packed into one row per block: identifiers, vector lengths, weights."""

    def pack(key, table):
        table = table.sort_by("vec_id").combine_chunks()
        vectors = table.column("v").combine_chunks()
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.table(
            {
                name: pa.array([key[0].as_py()], pa.int64()),
                "ids": [table.column("vec_id").to_numpy().astype(np.int64).tobytes()],
                "lens": [lengths.tobytes()],
                "weights": [vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes()],
            }
        )

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(count)))
    return dealt.groupBy(name).applyInArrow(pack, f"{name} long, ids binary, lens binary, weights binary")


def meetings(rows: DataFrame, queries: DataFrame, row_block: int, query_block: int) -> DataFrame:
    """Every block of rows beside every block of queries, once, in sorted partitions.

    Blocks of rows are dealt into as many parts as tasks need. For each (qb, part) the block of
    queries comes first (rb is -1), then the part's blocks of rows, one after another.
    """
    spark = rows.sparkSession
    r, q = max(1, -(-rows.count() // row_block)), max(1, -(-queries.count() // query_block))
    tasks = max(2 * cores(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = min(r, -(-tasks // q))
    numbered = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    fields = ["qb", "part", "rb", "ids", "lens", "weights"]
    left = blocks(rows, r, "rb").withColumn("part", F.pmod("rb", F.lit(parts))).withColumn("qb", numbered(q)).select(*fields)
    right = blocks(queries, q, "qb").withColumn("part", numbered(parts)).withColumn("rb", F.lit(-1).cast("long")).select(*fields)
    return left.unionByName(right).repartition(tasks, "qb", "part").sortWithinPartitions("qb", "part", "rb")


def unpack(ids: bytes, lens: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers and a dense matrix; a shorter vector has zeros at its end."""
    ids_, lens_ = np.frombuffer(ids, np.int64), np.frombuffer(lens, np.int64)
    flat = np.frombuffer(weights, np.float64)
    out = np.zeros((len(ids_), int(lens_.max(initial=0))))
    out[np.arange(out.shape[1]) < lens_[:, None]] = flat
    return ids_, out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller identifier; ``ids`` ascend."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, at = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
        return np.concatenate([above, at[: k - len(above)]])
    return np.arange(len(scores))


def better(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of each line, best first, ties to the smaller identifier."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def search(vectors: DataFrame, queries: DataFrame, k: int, index, find, kind: str, row_block: int, query_block: int) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` best rows.

    ``index(ids, rows)`` prepares a block of rows, ids ascending; ``find(index, asked, queries, k)``
    gives two arrays with a line of ``k`` per query: scores and identifiers, ``NONE`` and the
    lowest score where there are fewer. A task keeps ``k`` rows per query of the block at hand,
    so what is merged between tasks does not grow with the rows of a block.
    """
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64() if kind == "double" else pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = lines = held = None

        def done():
            ids = held[1]
            some = ids != NONE
            yield to_batch(schema, query_id=np.repeat(asked, some.sum(axis=1)), vec_id=ids[some], score=held[0][some])

        for batch in batches:
            for i in range(batch.num_rows):
                cell = {f: column(batch, f)[i].as_py() for f in ("rb", "ids", "lens", "weights")}
                ids, matrix = unpack(cell["ids"], cell["lens"], cell["weights"])
                if cell["rb"] < 0:
                    if held is not None:
                        yield from done()
                    asked, lines, held = ids, matrix, None
                elif asked is not None:
                    found = find(index(ids, matrix), asked, lines, k)
                    held = found if held is None else better(*(np.concatenate(x, axis=1) for x in zip(held, found, strict=True)), k)
        if held is not None:
            yield from done()

    partial = meetings(vectors, queries, row_block, query_block).mapInArrow(work, f"query_id long, vec_id long, score {kind}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def integer_type(rows: np.ndarray, queries: np.ndarray):
    """The narrowest type that holds every partial sum exactly; Python integers beyond 64 bits."""
    bound = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, rows.shape[1])
    return np.int32 if bound < 2**30 else np.int64 if bound < 2**62 else object


def accumulate(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Scores of queries x rows, one term after another, each scattered to the rows of its postings.

    A term that most rows hold is added to all of them, with zero weights for the others.
    """
    kind = integer_type(rows, queries)
    if kind is object:
        rows, queries = (np.array([int(y) for y in x.flat], object).reshape(x.shape) for x in (rows, queries))
    else:
        rows, queries = rows.astype(kind), queries.astype(kind)
    scores, product = np.zeros((len(queries), len(rows)), kind), np.empty((len(queries), len(rows)), kind)
    for term in range(min(rows.shape[1], queries.shape[1])):
        weights, asked = rows[:, term], np.flatnonzero(queries[:, term])
        holders = np.flatnonzero(weights)
        if 2 * len(holders) > len(rows):
            np.multiply(queries[:, term, None], weights[None, :], out=product)
            np.add(scores, product, out=scores)
        elif len(holders) and len(asked):
            scores[np.ix_(asked, holders)] += queries[asked, term, None] * weights[None, holders]
    return scores


def find_integers(block: tuple[np.ndarray, np.ndarray], asked: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's best of each query by accumulation and partition selection."""
    ids, rows = block
    top, names = np.full((len(asked), k), -_LIMIT, np.int64), np.full((len(asked), k), NONE, np.int64)
    place = len(ids) - 1 - np.arange(len(ids))
    for at in range(0, len(asked), STRIDE):
        scores = accumulate(rows, queries[at : at + STRIDE])
        if scores.dtype == object:
            scores = np.clip(scores, -_LIMIT, _LIMIT).astype(np.int64)
        own = ids[None, :] == asked[at : at + STRIDE, None]
        n = min(k, len(ids))
        if np.abs(scores).max(initial=0) < 2**50:  # score and place in one number: ties are settled in the selection
            key = np.where(own, -(2**62), scores.astype(np.int64) * len(ids) + place)
            chosen = np.argpartition(key, len(ids) - n, axis=1)[:, len(ids) - n :]
        else:
            chosen = np.array([best(np.where(o, -_LIMIT, line), ids, n) for o, line in zip(own, scores, strict=True)])
        kept = ~np.take_along_axis(own, chosen, 1)
        top[at : at + STRIDE, :n] = np.where(kept, np.take_along_axis(scores, chosen, 1), -_LIMIT)
        names[at : at + STRIDE, :n] = np.where(kept, ids[chosen], NONE)
    return top, names


def search_integers(vectors: DataFrame, queries: DataFrame, k: int = 20, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Each query's ``k`` highest integer inner products among all rows but its own.

    Both tables hold ``vec_id`` and ``v`` (whole numbers, as doubles). Returns query_id, rank,
    vec_id, score; ties go to the smaller vec_id. Rows of one vec_id never answer for each other.
    Vectors of unequal length meet as if the shorter ended in zeros. Empty tables give no rows.
    Scores beyond 64 bits are held at the limit of a long.
    """
    return search(vectors, queries, k, lambda ids, rows: (ids, rows), find_integers, "long", row_block, query_block)


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v: floor(scale * component) of every usable vector, as whole doubles."""
    kept = usable(vectors, "embedding")
    v = F.transform("embedding", lambda x: _floor(x, scale))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _floor(x, scale: int):
    """floor as a double: ``floor`` returns a 64-bit integer, which large components overflow."""
    y = x.cast("double") * float(scale)
    return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)


def top_vectors(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20) -> DataFrame:
    """The integer search with the rows whose vec_id is divisible by ``every`` as queries."""
    rows = quantised(vectors, scale)
    return search_integers(rows, rows.where(F.col("vec_id") % every == 0), k)
