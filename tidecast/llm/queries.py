"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidecast.llm import align, ann, langid, licenses, metric_join, near_dups, packing, pieces, quality, token_counts, token_files, topk, trie
from tidecast.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_vector_packing")
def op1_vector_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query(
    "op3_exact_topk",
    """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x AS double)) AS bigint)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, cast(list_dot_product(q.w::double[], c.w::double[]) AS bigint) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, cast(r AS integer) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20""",
)
def op3_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_vectors(read(spark, sf, "embeddings"))


@query("op7_token_files")
def op7_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.round_trip(read(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return langid.predict(docs, langid.train(docs))


@query("op5_line_quality")
def op5_line_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return quality.predict(docs, quality.train(docs, read(spark, sf, "labels")))


@query("op6_prefix_counts")
def op6_prefix_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.budgets(read(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_tensored_minhash")
def op9_tensored_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_dups.deduplicate(read(spark, sf, "documents"))


@query("op2_multiprobe")
def op2_multiprobe(spark: SparkSession, sf: str) -> DataFrame:
    return ann.nearest_vectors(read(spark, sf, "embeddings"))


@query("op10_license_scan")
def op10_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(read(spark, sf, "documents"))


@query("op8_piece_lattice")
def op8_piece_lattice(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.checked(read(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_run_alignment")
def op12_run_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return align.statistics(read(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query(
    "op13_lcp_trie",
    r"""WITH t AS (
  SELECT conv_id AS c, turn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, x, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, x) AS pos FROM t),
ids AS (
  SELECT c, c - c % 20 AS base, xor(4294967295, list_reduce(
    [4294967295::bigint] || flatten(list_transform(string_split(c::varchar, ''), lambda s: [ascii(s)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) % 4 AS h
  FROM (SELECT DISTINCT c FROM t)),
heads AS (SELECT i.c, o.pos AS d, x, w FROM ids i JOIN o ON o.c = i.base AND o.pos <= i.h),
taken AS (SELECT c, count(*) AS k FROM heads GROUP BY c),
turns AS (
  SELECT * FROM heads UNION ALL
  SELECT o.c, o.pos - i.h + coalesce(k, 0), x, w FROM o JOIN ids i ON o.c = i.c LEFT JOIN taken ON taken.c = o.c WHERE o.pos > i.h),
paths AS (
  SELECT c, d, w, list(x) OVER (PARTITION BY c ORDER BY d) AS path FROM turns
  UNION ALL SELECT c, 0, 0, []::varchar[] FROM ids),
nodes AS (SELECT d, path, min(c) AS c, count(*) AS n, max(w) AS w FROM paths GROUP BY d, path),
below AS (SELECT path[:d - 1] AS path, count(*) AS children FROM nodes WHERE d > 0 GROUP BY 1),
whole AS (SELECT nodes.*, coalesce(children, 0) AS children FROM nodes LEFT JOIN below USING (path)),
lengths AS (SELECT c, max(d) AS len FROM paths GROUP BY c),
ends AS (SELECT path, string_agg(p.c::varchar, ',' ORDER BY p.c) AS ids FROM paths p JOIN lengths l ON p.c = l.c AND p.d = l.len GROUP BY path),
up AS (SELECT n, w, children, unnest(list_transform(range(d + 1), lambda k: path[:k])) AS path FROM whole),
sums AS (SELECT path, sum((children = 0)::bigint) AS leaves, sum((n - 1) * w) AS saved FROM up GROUP BY path)
SELECT v.c AS conv_id, cast(v.d AS bigint) AS depth, p.c AS parent_conv_id, cast(v.n AS bigint) AS n_convs, cast(v.children AS bigint) AS n_children,
  cast(leaves AS bigint) AS n_leaves, cast(saved AS bigint) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM whole v JOIN sums USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes p ON v.d > 0 AND p.path = v.path[:v.d - 1]""",
)
def op13_lcp_trie(spark: SparkSession, sf: str) -> DataFrame:
    return trie.prefix_trie(read(spark, sf, "conversations"))


@query("op11_metric_join")
def op11_metric_join(spark: SparkSession, sf: str) -> DataFrame:
    return metric_join.similar(read(spark, sf, "documents"))
