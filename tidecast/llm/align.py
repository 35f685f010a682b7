"""Alignment of two tokenizers by diagonal run skipping, and statistics of the aligned pairs.

Both tokenizers cut the same bytes, so a text's tokens are two ascending arrays of byte ends. Where
both end at one byte a group closes. The walk keeps a shift between the two indexes: while tokens
match one to one it probes blocks of doubling width at that shift and jumps over them; at the first
difference it advances the side that is behind until both end together, which is one irregular
group, and goes on from the shift that this leaves.

Neither tokenizer lets a token reach over a space that follows other text, so both cut there. Each
distinct chunk between such spaces is encoded once per worker, the new chunks of a slice are laid
end to end, and one walk aligns them all; a text is the sequence of its chunks.

A pair's corpus-wide count needs a second look at each text. Texts are not read again: a slice
keeps its links as small codes into the slice's own distinct pairs, the pairs are counted in Spark,
and each slice meets the counts of its own pairs.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.llm.common import column, gather, offsets, slices, sums, texts_of, to_batch, written
from tidecast.llm.packing import ddl
from tidecast.llm.tokens import Encoder, chunked

SPACE = "▁"
#: Text handled at once; links between two looks are codes into a slice's distinct pairs.
SLICE = 3 << 20
#: Distinct chunks a worker keeps; beyond them it starts afresh.
KEPT = 350_000
#: Matches looked for one by one before blocks are probed, and the first block's width.
STEP, BLOCK = 4, 8
#: Bits of a B id in a pair.
BITS = 31

_LINKED = pa.schema(
    [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
     ("links", pa.list_(pa.int32())), ("slice", pa.int64()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
)
_STATS = pa.schema(
    [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()),
     ("count_sum", pa.int64()), ("groups_sha256", pa.string())]
)
_GROUPS = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.list_(pa.int64())), ("end", pa.list_(pa.int64())), ("a", pa.list_(pa.list_(pa.int32()))), ("b", pa.list_(pa.list_(pa.int32())))]
)


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes into ``a`` and ``b``, both strictly ascending, of the values they share, by diagonal run skipping."""
    ends_a, ends_b, i, j = a.tolist(), b.tolist(), 0, 0
    n, m = len(ends_a), len(ends_b)
    runs: list[tuple[int, int, int]] = []
    while i < n and j < m:
        x, y = ends_a[i], ends_b[j]
        if x != y:  # an irregular group: the side that is behind goes on, which changes the shift
            while x != y:
                if x < y:
                    i += 1
                    if i == n:
                        break
                    x = ends_a[i]
                else:
                    j += 1
                    if j == m:
                        break
                    y = ends_b[j]
            else:
                continue
            break
        most, run = min(n - i, m - j), 1
        while run < most and run < STEP and ends_a[i + run] == ends_b[j + run]:
            run += 1
        if run == STEP:
            width = BLOCK
            while run < most:
                width = min(width, most - run)
                same = a[i + run : i + run + width] == b[j + run : j + run + width]
                if not same.all():
                    run += int(np.argmin(same))
                    break
                run, width = run + width, 2 * width
        runs.append((i, j, run))
        i, j = i + run, j + run
    starts = np.array(runs, np.int64).reshape(-1, 3)
    within = gather(np.zeros(len(starts), np.int64), starts[:, 2], np.arange(len(starts)))
    return np.repeat(starts[:, 0], starts[:, 2]) + within, np.repeat(starts[:, 1], starts[:, 2]) + within


def byte_letters() -> dict[str, int]:
    """The byte behind every letter of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Plain(Encoder):
    """Ids of a byte-level tokenizer that takes the strings of special tokens as text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.bytes = [bytes(letters[c] for c in name) if all(c in letters for c in name) else b"" for name in names]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)


class Sentences:
    """Ids of a model that puts a space before every text; a chunk's own first space is that one."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(i) for i in range(self.model.vocab_size())]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def _bytes(self, i: int) -> bytes:
        if self.model.is_byte(i):
            return bytes([int(self.model.id_to_piece(i)[3:5], 16)])
        if self.model.is_control(i) or self.model.is_unknown(i):
            return b""
        return self.model.id_to_piece(i).replace(SPACE, " ").encode()

    def make(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = self.model.encode([c[1:] for c in chunks], out_type=int, num_threads=1) if chunks else []
        # The library puts no space before an empty text; a lone space ends a text here.
        made = [ids if c != " " else [self.model.piece_to_id(SPACE)] for c, ids in zip(chunks, made, strict=True)]
        counts = np.array([len(m) for m in made], np.int64)
        return np.array([i for m in made for i in m], np.uint32), counts


def spelled(ids_a: np.ndarray, ids_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;``: all groups as text, given the last token of each, and where each group begins in it."""
    last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    last_a[at_a], last_b[at_b] = True, True
    # A group's A tokens, then its B tokens: a token comes after its own side's and the other side's earlier groups.
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    ends_a, ends_b = np.append(0, at_a + 1), np.append(0, at_b + 1)
    order[np.arange(len(ids_a)) + ends_b[np.cumsum(last_a) - last_a]] = np.arange(len(ids_a))
    order[np.arange(len(ids_b)) + ends_a[np.cumsum(last_b) - last_b + 1]] = len(ids_a) + np.arange(len(ids_b))
    marks = np.concatenate([np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))])[order]
    numbers = pa.array(np.concatenate([ids_a, ids_b])[order]).cast(pa.large_string())
    marks = pa.Array.from_buffers(pa.large_string(), len(order), [None, pa.py_buffer(np.arange(len(order) + 1)), pa.py_buffer(marks.astype(np.uint8))])
    tokens = pc.binary_join_element_wise(numbers, marks, pa.scalar("", pa.large_string()))
    places = offsets(tokens)
    return (tokens.buffers()[2] or b"")[: places[-1]].to_pybytes() if len(order) else b"", places[ends_a + ends_b]


class Grown:
    """An array that is appended to in place."""

    def __init__(self, kind):
        self.held, self.size = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.held):
            self.held = np.concatenate([self.held[: self.size], np.zeros(max(need, 2 * len(self.held)) - self.size, self.held.dtype)])
        self.held[self.size : need] = values
        self.size = need

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.size]


class Aligner:
    """Alignments of chunks, each made once."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Plain(a), Sentences(b)
        self.forget()

    @staticmethod
    @cache
    def of(a: str, b: str) -> Aligner:
        """The one of this Python worker."""
        return Aligner(a, b)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.shown: list[bytes] = []
        self.pairs, self.sizes = Grown(np.int64), [Grown(np.int64) for _ in range(3)]
        self.begins = Grown(np.int64)

    def aligned(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """Ids and counts of both sides, and which chunks both sides spell as they are."""
        (ids_a, n_a), (ids_b, n_b) = self.a.make(chunks), self.b.make(chunks)
        whole = [c.encode() for c in chunks]
        right = np.ones(len(chunks), bool)
        for ids, n, side in ((ids_a, n_a, self.a), (ids_b, n_b, self.b)):
            sizes = sums(side.sizes[ids], np.concatenate([[0], np.cumsum(n)]))
            if sizes.tolist() != [len(w) for w in whole] or b"".join([side.bytes[i] for i in ids.tolist()]) != b"".join(whole):
                at = np.concatenate([[0], np.cumsum(n)])
                right &= [b"".join([side.bytes[i] for i in ids[p:q].tolist()]) == w for p, q, w in zip(at[:-1], at[1:], whole, strict=True)]
        return ids_a, n_a, ids_b, n_b, right

    def learn(self, chunks: list[str]) -> None:
        ids_a, n_a, ids_b, n_b, right = self.aligned(chunks)
        if not right.all():
            ids_a, ids_b = ids_a[np.repeat(right, n_a)], ids_b[np.repeat(right, n_b)]
            n_a, n_b = np.where(right, n_a, 0), np.where(right, n_b, 0)
        at_a, at_b = common_ends(np.cumsum(self.a.sizes[ids_a]), np.cumsum(self.b.sizes[ids_b]))
        # A chunk's groups are those whose last A token is one of its own.
        firsts = np.searchsorted(at_a, np.concatenate([[0], np.cumsum(n_a)]))
        text, begins = spelled(ids_a, ids_b, at_a, at_b)
        bounds = begins[firsts].tolist()
        self.known.update(zip(chunks, range(len(self.shown), len(self.shown) + len(chunks)), strict=True))
        self.shown += [text[p:q] for p, q in zip(bounds[:-1], bounds[1:], strict=True)]
        self.begins.add(self.pairs.size + firsts[:-1])
        self.pairs.add((ids_a[at_a].astype(np.int64) << BITS) | ids_b[at_b])
        for held, values in zip(self.sizes, (np.where(right, n_a, -1), n_b, np.diff(firsts)), strict=True):
            held.add(values)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The code of each chunk of every text, in order, each text's first chunk, and whether it has tokens."""
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        chunks, codes, rows = chunked(pc.binary_join_element_wise(pa.scalar(" "), texts, ""), spaces=True)
        if len(self.shown) > KEPT:
            self.forget()
        new = [c for c in chunks if c not in self.known]
        if new:
            self.learn(new)
        codes = np.array([self.known[c] for c in chunks], np.int64)[codes]
        wrong = sums((self.sizes[0].values[codes] < 0).astype(np.int64), rows)
        return codes, rows, (lengths > 0) & (wrong == 0)


def _kept(codes: np.ndarray, rows: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the chunks of the texts that have tokens."""
    sizes = np.where(some, np.diff(rows), 0)
    return codes[np.repeat(some, np.diff(rows))], np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def linked(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Every text's counts, digest and links; a slice's first row also holds its distinct pairs and how often it has each.

    ``links`` are indexes into those pairs, which ascend.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, aligner = TaskContext.get().partitionId() << 32, Aligner.of(a, b)
        for batch in slices(batches, limit=SLICE):
            codes, rows, some = aligner.texts(column(batch, "text"))
            codes, rows = _kept(codes, rows, some)
            n_a, n_b, n_groups = (sums(held.values[codes], rows) for held in aligner.sizes)
            counts = aligner.sizes[2].values
            pairs, links, times = np.unique(aligner.pairs.values[gather(aligner.begins.values, counts, codes)], return_inverse=True, return_counts=True)
            listed, shown = codes.tolist(), aligner.shown
            sha = [hashlib.sha256(b"".join([shown[c] for c in listed[p:q]])[:-1]).hexdigest() if q > p else "" for p, q in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
            links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_groups)]), pa.int32()), pa.array(links.ravel().astype(np.int32)))
            rest = [None] * (batch.num_rows - 1)
            yield to_batch(
                _LINKED, doc_id=column(batch, "doc_id"), n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_groups, groups_sha256=sha, links=links,
                slice=np.full(batch.num_rows, number), pairs=[pairs, *rest], times=[times, *rest],
            )
            number += 1

    return texts_of(docs).mapInArrow(work, ddl(_LINKED))


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n, best: how many links of the corpus hold each id pair, and whether no pair of its B id has more."""
    each = links.where(F.col("pairs").isNotNull()).select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counted = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    b = F.col("pair").bitwiseAND(F.lit((1 << BITS) - 1))
    # At most as many rows a B id as A has ids.
    return counted.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy(b)))


def pair_table(docs: DataFrame, a: str, b: str) -> DataFrame:
    """a_id, b_id, n, best: the translation table of two vocabularies, from all texts."""
    counted = pair_counts(written(linked(docs, a, b), "links"))
    return counted.select(F.shiftright("pair", BITS).alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << BITS) - 1)).alias("b_id"), "n", "best")


def statistics(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of ``docs`` (doc_id, text).

    Null and empty texts, and texts that a tokenizer's tokens do not spell (the model writes a space
    as a letter that texts may hold themselves), have no tokens: zeros and an empty digest. Rows that
    repeat a doc_id or lack one are texts of their own. Other columns are left out.
    """
    links = written(linked(docs, a, b), "links")
    counted = written(pair_counts(links), "pairs")
    asked = links.where(F.col("pairs").isNotNull()).select(F.col("slice").alias("of"), F.explode("pairs").alias("pair"))
    met = asked.join(counted, "pair").select("of", "pair", "n", "best")

    def meet(part: pa.Table, counts: pa.Table) -> pa.Table:
        order = np.argsort(counts.column("pair").to_numpy())
        n, best = counts.column("n").to_numpy()[order], counts.column("best").to_numpy()[order]
        out = {f.name: part.column(f.name) for f in _STATS if f.name in part.column_names}
        places = part.column("links").combine_chunks()
        bounds = np.concatenate([[0], np.cumsum(places.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        places = places.flatten().to_numpy(zero_copy_only=False)
        out["n_best"] = pa.array(sums(best[places].astype(np.int64), bounds), pa.int64())
        out["count_sum"] = pa.array(sums(n[places], bounds), pa.int64())
        return pa.table({f.name: out[f.name] for f in _STATS}, schema=_STATS)

    return links.drop("pairs", "times").groupBy("slice").cogroup(met.groupBy("of")).applyInArrow(meet, ddl(_STATS))


def groups(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, start, end, a, b: the byte range of every group in a space and the text, and the ids of both sides.

    Texts without tokens, as in ``statistics``, have empty lists.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(a, b)
        for batch in slices(batches, limit=SLICE):
            codes, rows, some = aligner.texts(column(batch, "text"))
            codes, rows = _kept(codes, rows, some)
            out: dict[str, list] = {"start": [], "end": [], "a": [], "b": []}
            for p, q in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                sides = [[list(map(int, ids.split(","))) for ids in group.split("|")] for c in codes[p:q].tolist() for group in aligner.shown[c].decode().split(";")[:-1]]
                ends = np.cumsum([sum(len(aligner.a.bytes[i]) for i in left) for left, _ in sides], dtype=np.int64)
                out["start"].append(np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else [])
                out["end"].append(ends)
                out["a"].append([left for left, _ in sides])
                out["b"].append([right for _, right in sides])
            yield to_batch(_GROUPS, doc_id=column(batch, "doc_id"), **out)

    return texts_of(docs).mapInArrow(work, "doc_id long, start array<long>, end array<long>, a array<array<int>>, b array<array<int>>")
