"""Approximate nearest neighbours by inner product: multiprobe hashing with p-stable projections.

A vector is scaled by the largest norm and gets one more component that makes it a unit vector, so
that the largest inner product with a query is the smallest distance. A table cuts ``K`` Gaussian
projections into slots of width ``WIDTH``; the slots are the bucket. A query visits the occupied
buckets of all tables, not its own only, in the order of their estimated success: the nearer a
bucket's middle lies to the query's projections, the likelier it holds near vectors. It stops when
the visited buckets hold ``VISITED`` times as many entries as the block has vectors, and goes on where fewer
identifiers than asked for are met; it merges the tables' candidates, and ranks them by the exact inner product of the original vectors.

Rows and queries meet in blocks (``topk.search``). Every row is indexed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import gather
from tidecast.llm.topk import NONE, best, search, usable

#: Tables, projections of a table, width of a slot against unit vectors, and how far to visit.
TABLES, K, WIDTH, VISITED = 4, 8, 2.0, 1.0
ROW_BLOCK, QUERY_BLOCK = 1024, 512
SEED = 20


class Block:
    """The tables of one block of rows; copies of a vector are one entry."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, norm: float, tables: int, k: int, width: float):
        self.rows, inverse = np.unique(rows, axis=0, return_inverse=True)
        order = np.argsort(inverse.ravel(), kind="stable")
        self.ids, self.copies = ids[order], np.bincount(inverse.ravel(), minlength=len(self.rows))
        self.first = np.cumsum(self.copies) - self.copies
        random = np.random.default_rng(SEED)
        self.lines = random.standard_normal((rows.shape[1] + 1, tables * k)) / width
        self.shift = random.random(tables * k)
        scaled = self.rows / norm
        rest = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))
        slots = np.floor(self.projected(np.column_stack([scaled, rest]))).reshape(len(self.rows), tables, k)
        self.k, self.middles, members, sizes = k, [], [], []
        for t in range(tables):
            buckets, inverse = np.unique(slots[:, t], axis=0, return_inverse=True)
            members.append(np.argsort(inverse.ravel(), kind="stable"))
            sizes.append(np.bincount(inverse.ravel(), minlength=len(buckets)))
            self.middles.append(buckets + 0.5)
        self.members, self.sizes = np.concatenate(members), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def projected(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.lines + self.shift

    def candidates(self, queries: np.ndarray, visited: float) -> np.ndarray:
        """Which distinct vectors each query meets, as a table of yes and no."""
        length = np.sqrt((queries**2).sum(axis=1, keepdims=True))
        unit = np.column_stack([queries / length, np.zeros(len(queries))])
        places = self.projected(unit)
        far = [
            (m**2).sum(axis=1) - 2 * places[:, t * self.k : (t + 1) * self.k] @ m.T + (places[:, t * self.k : (t + 1) * self.k] ** 2).sum(axis=1)[:, None]
            for t, m in enumerate(self.middles)
        ]
        order = np.argsort(np.concatenate(far, axis=1).astype(np.float32), axis=1)
        before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        query, at = np.nonzero(before < visited * len(self.rows))
        buckets = order[query, at]
        found = np.zeros((len(queries), len(self.rows)), bool)
        found[np.repeat(query, self.sizes[buckets]), self.members[gather(self.starts, self.sizes, buckets)]] = True
        return found

    def find(self, asked: np.ndarray, queries: np.ndarray, k: int, visited: float) -> tuple[np.ndarray, np.ndarray]:
        top, names = np.full((len(asked), k), -np.inf), np.full((len(asked), k), NONE, np.int64)
        width = self.rows.shape[1]
        wide = np.zeros((len(queries), width))
        wide[:, : min(width, queries.shape[1])] = queries[:, :width]
        some = np.flatnonzero((wide != 0).any(axis=1))  # a query may lie in components this block does not have
        found = np.ones((len(queries), len(self.rows)), bool)
        if len(some):
            found[some] = self.candidates(wide[some], visited)
        enough = min(k + 1, len(self.ids))
        while len(some := some[found[some] @ self.copies < enough]):
            visited *= 2  # beyond the number of tables every bucket is visited
            found[some] = self.candidates(wide[some], visited)
        few = np.minimum(self.copies, k + 1)  # of equal vectors only the smallest identifiers can be among the best
        for i in range(len(asked)):
            near = np.flatnonzero(found[i])
            scores = self.rows[near] @ wide[i]
            if len(near) > k + 1:
                edge = np.partition(scores, len(near) - k - 1)[len(near) - k - 1]
                near, scores = near[scores >= edge], scores[scores >= edge]
            ids = self.ids[gather(self.first, few, near)]
            scores = np.repeat(scores, few[near])
            other = np.flatnonzero(ids != asked[i])
            other = other[np.argsort(ids[other])]
            chosen = other[best(scores[other], ids[other], k)]
            top[i, : len(chosen)], names[i, : len(chosen)] = scores[chosen], ids[chosen]
        return top, names


def search_nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = TABLES, projections: int = K, width: float = WIDTH, visited: float = VISITED
) -> DataFrame:
    """Each query's ``k`` nearest found by inner product, among all rows but its own.

    Both tables hold ``vec_id`` and ``v`` (doubles). Returns query_id, rank, vec_id and score, the
    inner product in double precision; ties go to the smaller vec_id. All candidates, if there are
    fewer than ``k``. Empty tables give no rows.
    """
    largest = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    norm = float(largest) ** 0.5 * (1 + 1e-12) if largest else 1.0
    index = lambda ids, rows: Block(ids, rows, norm, tables, projections, width)
    find = lambda block, asked, lines, n: block.find(asked, lines, n, visited)
    return search(vectors, queries, k, index, find, "double", ROW_BLOCK, QUERY_BLOCK)


def nearest_vectors(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The search over ``embeddings``, with the rows whose vec_id is divisible by ``every`` as queries.

    Null vectors, zero vectors, and vectors with null or non-finite components take no part.
    """
    kept = usable(vectors, "embedding").where(F.exists("embedding", lambda x: x != 0))
    rows = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return search_nearest(rows, rows.where(F.col("vec_id") % every == 0), k)
