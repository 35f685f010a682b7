"""Packing under several limits at once: the dot-product heuristic for vector bins.

A piece asks for three things: tokens, one segment, and loss-bearing tokens. A bin is filled one
piece at a time: among the pieces that still fit in every dimension, the one whose demand has the
largest dot product with what the bin has left, each dimension weighted by the average demand, so
that pieces are chosen that use what the bin has most of. When none fits, the next bin opens.

Pieces are dealt into blocks of about ``BLOCK`` by a hash, so blocks are alike whatever a source
holds, and each is packed alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import numbers, slices, texts_of, to_batch, written
from tidecast.llm.tokens import token_ids

SEQUENCE = 2048
#: Segments of a sequence: documents that attend to themselves only.
SEGMENTS = 256
#: Pieces packed together. The last sequences of a block are the ones left part empty.
BLOCK = 4096
#: A sequence's number is its block's number times this, plus its place in the block.
PER_BLOCK = 1 << 20

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("loss", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
)
_WITH_IDS = _PIECES.append(pa.field("ids", pa.list_(pa.int32())))


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.bool_(): "boolean", pa.binary(): "binary", pa.string(): "string"}
    name = lambda t: f"array<{name(t.value_type)}>" if pa.types.is_list(t) else kinds[t]
    return ", ".join(f"{f.name} {name(f.type)}" for f in schema)


def cut(docs: DataFrame, path: str, end: int = 1, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Whole documents as pieces of at most ``size`` ids, ``end`` closing each document.

    doc_id, start, length, loss (every id but a document's first, which nothing predicts),
    ids_crc32, doc_tokens, and with ``with_ids`` the ids. A null or empty text is the end id
    alone. Rows that repeat a doc_id are documents of their own; other columns are left out.
    """
    schema = _WITH_IDS if with_ids else _PIECES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, bounds = token_ids(batch, path, end)
            ids = ids.astype("<u4")
            totals = np.diff(bounds)
            parts = -(-totals // size)
            row = np.repeat(np.arange(len(totals)), parts)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * size
            begin = bounds[row] + start
            length = np.minimum(size, totals[row] - start)
            crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            doc = pa.array(batch.column(0)).take(pa.array(row))
            cols = {"doc_id": doc, "start": start, "length": length, "loss": length - (start == 0), "ids_crc32": crc, "doc_tokens": totals[row]}
            if with_ids:
                cols["ids"] = [ids[a : a + n].astype(np.int32) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            yield to_batch(schema, **cols)

    return texts_of(docs).mapInArrow(work, ddl(schema))


def fill(demands: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each row of ``demands`` and its place there; rows that are alike count as one kind.

    A demand that no empty bin holds is an error.
    """
    if (demands > limits).any():
        raise ValueError("a piece asks for more than an empty sequence has")
    if not len(demands):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds, inverse = np.unique(demands, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    members = np.argsort(inverse, kind="stable")
    left = np.bincount(inverse, minlength=len(kinds))
    taken = np.cumsum(left) - left
    weight = demands.mean(axis=0) / limits / limits
    bins, places = np.empty(len(demands), np.int64), np.empty(len(demands), np.int64)
    number, room, place = 0, limits.copy(), 0
    for done in range(len(demands)):
        fits = (left > 0) & (kinds <= room).all(axis=1)
        if not fits.any():
            number, room, place = number + 1, limits.copy(), 0
            fits = left > 0
        kind = int(np.argmax(np.where(fits, kinds @ (weight * room), -1.0)))
        at = members[taken[kind]]
        bins[at], places[at] = number, place
        room, place = room - kinds[kind], place + 1
        taken[kind] += 1
        left[kind] -= 1
    return bins, places


def pack(pieces: DataFrame, tokens: int = SEQUENCE, segments: int = SEGMENTS, loss: int = SEQUENCE, block: int = BLOCK) -> DataFrame:
    """``pieces`` with the sequence each lies in and its offset there, gapless from 0.

    Needs doc_id, start, length and loss, with no length over ``tokens``; keeps every column.
    ``sequence_id`` is unique, ascending within a block, and the same on every run. An empty
    table stays empty.
    """
    limits = np.array([tokens, segments, loss], np.int64)
    blocks = max(1, -(-pieces.count() // block))
    schema = pieces.schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id long, offset long"

    def work(key, table):
        table = table.drop_columns(["_block"]).sort_by([(c, "ascending") for c in ("length", "loss", "doc_id", "start", "ids_crc32") if c in table.column_names])
        demands = np.column_stack([table.column("length").to_numpy(), np.ones(len(table), np.int64), table.column("loss").to_numpy()])
        bins, places = fill(demands, limits)
        order = np.lexsort([places, bins])
        lengths = demands[order, 0]
        ends = np.cumsum(lengths)
        new = np.append(True, bins[order][1:] != bins[order][:-1])
        base = np.maximum.accumulate(np.where(new, ends - lengths, 0))
        table = table.take(pa.array(order))
        table = table.append_column("sequence_id", pa.array(key[0].as_py() * PER_BLOCK + bins[order], pa.int64()))
        return table.append_column("offset", pa.array(ends - lengths - base, pa.int64()))

    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)))
    return dealt.groupBy("_block").applyInArrow(work, schema)


def pack_documents(docs: DataFrame, path: str, end: int = 1) -> DataFrame:
    """Every document cut and packed. The pieces, without their ids, are written once before."""
    return pack(written(cut(docs, path, end), "pieces"))
