import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import awkward, awkward_rows, empty, words
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidecast.llm import packing, token_counts, token_files
from tidecast.llm.tokens import chunked, token_ids

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = st.text(alphabet=st.sampled_from(list("ab '\n\t\r.,!srevl dm12é日  \x1ć<|endoftext|>😀")), max_size=60)


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def batch(texts):
    return pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=5))
def test_ids_of_chunks_are_the_librarys(texts):
    for path in (BYTE, WORD):
        ids, bounds = token_ids(batch(texts), path)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == library(path, texts)


def test_chunks_join_to_the_texts():
    texts = [r[1] or "" for r in awkward_rows()]
    distinct, codes, rows = chunked(pa.array(texts))
    assert ["".join(distinct[c] for c in codes[a:b]) for a, b in zip(rows[:-1], rows[1:], strict=True)] == texts


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_every_prefix_count_is_the_librarys(text):
    values, _ = token_counts.Prefixes(batch([text]), BYTE).all()
    encoder = Tokenizer.from_file(BYTE) if not hasattr(test_every_prefix_count_is_the_librarys, "t") else test_every_prefix_count_is_the_librarys.t
    test_every_prefix_count_is_the_librarys.t = encoder
    for k in range(1, len(text) + 1):
        assert values[len(text[:k].encode()) - 1] == len(encoder.encode(text[:k], add_special_tokens=False).ids), text[:k]


def test_budgets_and_cuts(spark):
    got = token_counts.budgets(awkward(spark), BYTE, limit=16).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(i)) for r, i in zip(awkward_rows(), library(BYTE, [r[1] or "" for r in awkward_rows()]), strict=True))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    text = {r[0]: r[1] or "" for r in awkward_rows()}
    for r in got:
        assert r["over_limit"] == (r["n_tokens"] > 16)
        if r["doc_id"] in (8, 9, 10):
            prefixes = [text[r["doc_id"]][:k] for k in range(1, min(400, len(text[r["doc_id"]])) + 1)]
            fits = [len(p.encode()) for p, ids in zip(prefixes, library(BYTE, prefixes), strict=True) if len(ids) <= 16]
            assert r["cut_bytes"] == max(fits)
    assert token_counts.budgets(empty(spark), BYTE).count() == 0
    assert token_counts.budgets(awkward(spark), BYTE, limit=0).where("n_tokens > 0 and cut_bytes > 0").count() == 0


def test_prefix_table(spark):
    rows = token_counts.prefix_table(awkward(spark), BYTE).where("doc_id = 10").collect()
    text = next(r[1] for r in awkward_rows() if r[0] == 10)
    assert len(rows[0]["counts"]) == len(text.encode()) and rows[0]["counts"][-1] == len(library(BYTE, [text])[0])


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_files_round_trip(spark, path):
    got = token_files.round_trip(awkward(spark), path).collect()
    rows = sorted(awkward_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [x + [1] for x in library(path, [r[1] or "" for r in rows])]
    start = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    want = [(r[0], s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, s, i in zip(rows, start, ids, strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_files.round_trip(empty(spark), path).count() == 0


def test_files_are_read_through_other_stores(spark, tmp_path):
    manifest = token_files.write(awkward(spark), BYTE, folder=f"file://{tmp_path}/ids")
    assert manifest.agg({"n_docs": "sum"}).first()[0] == len(awkward_rows())
    assert token_files.read(spark, manifest).count() == len(awkward_rows())


def brute_pieces(path):
    out = {}
    for r, ids in zip(awkward_rows(), library(path, [r[1] or "" for r in awkward_rows()]), strict=True):
        ids = ids + [1]
        for s in range(0, len(ids), packing.SEQUENCE):
            part = ids[s : s + packing.SEQUENCE]
            out.setdefault((r[0], s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)), []).append(1)
    return {k: len(v) for k, v in out.items()}


def test_packing_places_every_piece_once(spark):
    got = packing.pack_documents(awkward(spark), BYTE).toPandas()
    keys = got.astype(object).where(got.notna(), None)[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].apply(tuple, axis=1)
    assert keys.value_counts().to_dict() == brute_pieces(BYTE)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all() and g.length.sum() <= packing.SEQUENCE
    assert packing.pack_documents(empty(spark), BYTE).count() == 0


def test_packing_keeps_all_limits_and_ids(spark):
    docs = spark.createDataFrame([(i, words(i % 90, i)) for i in range(400)], "doc_id long, text string")
    pieces = packing.cut(docs, BYTE, size=100, with_ids=True)
    got = packing.pack(pieces, tokens=128, segments=3, loss=100, block=150).toPandas()
    by = got.groupby("sequence_id")
    assert by.length.sum().max() <= 128 and by.size().max() <= 3 and by.loss.sum().max() <= 100
    assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(got.ids, got.ids_crc32, strict=True))


def test_fill_is_the_heuristic():
    limits = np.array([10, 3, 10])
    demands = np.array([[6, 1, 1], [5, 1, 5], [4, 1, 4], [4, 1, 0], [2, 1, 2]])
    bins, places = packing.fill(demands, limits)
    weight = demands.mean(axis=0) / limits / limits
    left, room, number, want = set(range(5)), limits.copy(), 0, {}
    while left:
        fits = [i for i in left if (demands[i] <= room).all()]
        if not fits:
            number, room = number + 1, limits.copy()
            continue
        pick = max(fits, key=lambda i: demands[i] @ (weight * room))
        want[pick] = number
        room = room - demands[pick]
        left.remove(pick)
    assert bins.tolist() == [want[i] for i in range(5)]
    assert all(sorted(places[bins == b]) == list(range((bins == b).sum())) for b in set(bins.tolist()))
    with pytest.raises(ValueError):
        packing.fill(np.array([[11, 1, 1]]), limits)


def test_packing_leaves_little_padding(spark):
    docs = spark.createDataFrame([(i, words(20 + i * 7 % 400, i)) for i in range(1500)], "doc_id long, text string")
    got = packing.pack_documents(docs, BYTE).toPandas()
    assert got.length.sum() / (got.sequence_id.nunique() * packing.SEQUENCE) > 0.98
