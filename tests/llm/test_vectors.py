import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.llm import ann, topk

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("v", "qb", "rb", "part", "ids", "rank", "score", "query_id")})


def awkward(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.standard_normal(6).tolist(), 0) for i in range(100)]
    rows += [(200 + i, rows[0][1], 0) for i in range(50)]  # copies, query 200, 220, 240 among them
    rows += [(300, None, 0), (301, [None] * 6, 0), (302, [NAN] * 6, 0), (303, [INF, 0.0, 0.0, 0.0, 0.0, 0.0], 0), (320, [0.0] * 6, 0), (None, [1.0] * 6, 0)]
    rows += [(340, [1.0, 2.0], 0), (341, [], 0)]
    return rows


def usable(rows):
    return {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}


def wide(v, n):
    return np.concatenate([v, np.zeros(n - len(v))])


def brute(vectors, k, measure):
    n = max(len(v) for v in vectors.values())
    out = {}
    for q in vectors:
        if q % 20 == 0:
            scored = sorted((-measure(wide(vectors[q], n), wide(v, n)), i) for i, v in vectors.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_integer_search_is_exact(spark):
    rows = awkward(spark)
    got = topk.top_vectors(table(spark, rows), k=20).collect()
    want = brute({i: np.floor(64 * v) for i, v in usable(rows).items()}, 20, lambda a, b: int(a @ b))
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == {(q, n + 1, i, s) for q, found in want.items() for n, (i, s) in enumerate(found)}


def test_small_blocks_give_the_same(spark):
    rows = topk.quantised(table(spark, awkward(spark)))
    queries = rows.where("vec_id % 20 = 0")
    assert set(map(tuple, topk.search_integers(rows, queries, 7, 8, 3).collect())) == set(map(tuple, topk.search_integers(rows, queries, 7).collect()))


def test_accumulation_of_sparse_and_huge_terms():
    rows = np.array([[0, 2.0, 0], [3.0, 0, 0], [0, 0, 0], [0, 0, -5.0]])
    queries = np.array([[0, 1.0, 2.0], [4.0, 0, 0]])
    assert topk.accumulate(rows, queries).tolist() == (queries @ rows.T).tolist()
    big = np.array([[2.0**52, 1.0]])
    assert topk.accumulate(big, big).tolist() == [[2**104 + 1]]


def test_empty_tables_have_no_answers(spark):
    none = table(spark, [(1, None, 0)])
    assert topk.top_vectors(none).count() == 0 and ann.nearest_vectors(none).count() == 0
    alone = table(spark, [(20, [1.0, 2.0], 0)])
    assert topk.top_vectors(alone).count() == 0 and ann.nearest_vectors(alone).count() == 0


def test_visiting_everything_is_exact(spark):
    rows = awkward(spark)
    vectors = {i: v for i, v in usable(rows).items() if np.any(v != 0)}
    kept = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, v array<double>")
    got = ann.search_nearest(kept, kept.where("vec_id % 20 = 0"), visited=1e9).collect()
    want = brute(vectors, 20, lambda a, b: a @ b)
    by = {(r["query_id"], r["rank"]): r for r in got}
    assert len(by) == sum(map(len, want.values()))
    for q, found in want.items():
        assert [by[q, n + 1]["score"] for n in range(len(found))] == pytest.approx([s for _, s in found], abs=1e-12)
    copies = [by[0, n + 1]["vec_id"] for n in range(20) if by[0, n + 1]["vec_id"] >= 200]
    assert copies == list(range(200, 200 + len(copies))) and len(copies) > 10  # equal scores: smallest identifiers first


def test_recall_on_vectors_without_structure(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = ann.nearest_vectors(rows).toPandas()
    x = x.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 4000, 20):
        s = x @ x[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:20]) & set(got[got.query_id == q].vec_id))
    assert hits / (200 * 20) >= 0.9
    assert (got.groupby("query_id").size() == 20).all()
    assert np.allclose(got.score, [x[a] @ x[b] for a, b in zip(got.query_id, got.vec_id, strict=True)], atol=1e-12)


@pytest.mark.parametrize("n", [5, 10, 15, 21, 30, 40])
def test_small_tables_give_as_many_neighbours_as_there_are(spark, n):
    r = np.random.default_rng(n)
    got = ann.nearest_vectors(table(spark, [(i, r.standard_normal(64).tolist(), 0) for i in range(n)])).collect()
    for q in range(0, n, 20):
        assert sorted(x["rank"] for x in got if x["query_id"] == q) == list(range(1, min(20, n - 1) + 1))
