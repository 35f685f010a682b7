import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from helpers import awkward, awkward_rows, empty, words
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidecast.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ROWS = [(r[0], r[1]) for r in awkward_rows()] + [
    (20, "a ▁ sign"), (21, "  two  spaces "), (22, "\ttab\nline  \n x"), (23, "re <|endoftext|> <s> </s> <unk> <0x41>"), (24, "\x00 nul"), (25, " "),
    (26, words(400, 5, "abcé")), (27, "non break　ideographic   line"),
]


def brute(rows):
    """Both libraries on whole texts, sets of byte ends, counters."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = align.byte_letters()
    links, made = [], []
    for _, text in rows:
        whole = (" " + (text or "")).encode()
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = (dict(zip(np.cumsum([len(x) for x in side]).tolist(), range(1, len(side) + 1), strict=True)) for side in (bytes_a, bytes_b))
        shared = sorted(set(ends_a) & set(ends_b))
        p = q = 0
        groups = []
        for e in shared:
            groups.append((ids_a[p : ends_a[e]], ids_b[q : ends_b[e]]))
            p, q = ends_a[e], ends_b[e]
        links.append([(x[-1], y[-1]) for x, y in groups])
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        made.append((len(ids_a), len(ids_b), len(groups), hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    counts = Counter(x for pairs in links for x in pairs)
    top: dict[int, int] = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    return sorted(
        (-1 if d is None else d, n_a, n_b, n, n, sum(counts[x] == top[x[1]] for x in pairs), sum(counts[x] for x in pairs), sha)
        for (d, _), pairs, (n_a, n_b, n, sha) in zip(rows, links, made, strict=True)
    )


def rows_of(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, df.collect()))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_statistics_are_those_of_the_libraries_on_whole_texts(spark, monkeypatch):
    expected = brute(ROWS)
    assert rows_of(align.statistics(frame(spark, ROWS).repartition(3), A, B)) == expected
    assert any(r[1] == 0 and r[0] == 20 for r in expected)
    assert expected != brute(ROWS[:-1])


def test_other_columns_and_empty_tables(spark):
    assert rows_of(align.statistics(awkward(spark), A, B)) == brute([(r[0], r[1]) for r in awkward_rows()])
    assert align.statistics(empty(spark), A, B).collect() == []
    assert align.groups(empty(spark), A, B).collect() == []


def test_pair_table_and_groups(spark):
    docs = frame(spark, ROWS)
    table = align.pair_table(docs, A, B).collect()
    assert sum(r["n"] for r in table) == sum(r[4] for r in brute(ROWS))
    for r in align.groups(docs, A, B).collect():
        text = dict(ROWS).get(r["doc_id"]) if r["doc_id"] is not None else None
        if text and r["end"]:
            assert r["start"] == [0, *r["end"][:-1]] and r["end"][-1] == len((" " + text).encode())
            assert sum(map(len, r["a"])) == len(align.Plain.of(A).tokenizer.encode(" " + text, add_special_tokens=False).ids)


def test_a_worker_that_forgets_gives_the_same(monkeypatch):
    texts = pa.array([r[1] or "" for r in ROWS])
    aligner = align.Aligner(A, B)
    first = aligner.texts(texts)
    shown = [[aligner.shown[c] for c in first[0][p:q]] for p, q in zip(first[1][:-1], first[1][1:], strict=True)]
    monkeypatch.setattr(align, "KEPT", 1)
    again = aligner.texts(texts)
    assert [[aligner.shown[c] for c in again[0][p:q]] for p, q in zip(again[1][:-1], again[1][1:], strict=True)] == shown


ENDS = st.lists(st.integers(1, 3), min_size=0, max_size=80).map(lambda steps: np.cumsum(steps, dtype=np.int64))


@settings(max_examples=300, deadline=None)
@given(ENDS, ENDS, st.integers(0, 60))
def test_common_ends_are_the_intersection(a, b, same):
    run = np.arange(1, same + 1)  # a one-to-one stretch in front, long enough for blocks
    a, b = np.concatenate([run, a + same]), np.concatenate([run, b + same])
    i, j = align.common_ends(a, b)
    assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
