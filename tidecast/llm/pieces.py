"""SentencePiece encoding and decoding through a relational lattice.

1. Texts are cut into units wherever two neighbouring characters stand side by side in no piece:
   no piece can reach across, so units are encoded alone, each distinct one once.
2. Every distinct unit is exploded into its substrings of bounded length, and an equality join with
   the piece table keeps those that are pieces: the edges of the unit's lattice.
3. Edges are grouped by unit and folded with Spark's higher-order ``aggregate``. For a unigram model
   the fold is Viterbi's: the best score up to each character. For a byte-pair model Viterbi gives
   other ids than the library, as its scores are an order of merges and no costs; there the fold
   carries the set of cuts and in each step takes the best edge that spans two neighbours.
4. Units go back to their texts. The table of units is sent to every task where its measured size
   allows it, else texts and units meet in a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.llm.common import column, cores, gather, numbers, slices, texts_of, to_batch, written
from tidecast.llm.packing import ddl
from tidecast.llm.tokens import chunked

SPACE = "▁"
#: Characters of a unit that the fold can hold: a cut is a bit of a long. Longer units, which real
#: text hardly has, are merged by the same rule in the task that meets them.
UNIT = 60
#: Characters below this code point have a table of their pairs.
LOW = 1024
#: Distinct units up to which their table is sent to every task: about 30 bytes each.
SENT_UNITS = 16_000_000
#: Text handled at once, where units are gathered and where a task also holds the table.
GATHERED, SLICE = 4 << 20, 2 << 20
#: Text that a group holds where texts and units are joined.
GROUP_BYTES = 16 << 20

_UNITS = pa.schema([("unit", pa.string())])
_TABLED = pa.schema([("unit", pa.string()), ("ids", pa.list_(pa.int32()))])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_CHECKED = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])


class Pieces:
    """The vocabulary of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("only models that keep the text and put a space before it are supported")
        self.unigram = model.trainer_spec.model_type == 1
        #: Pieces by their text: id and score. Kinds: 1 normal, 2 unknown, 4 user-defined, 6 byte.
        self.normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type in (1, 4)}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.encode() if p.type in (1, 4) else b"" for p in model.pieces]
        self.longest = max(map(len, self.normal))
        inner = {a + b for p in self.normal for a, b in zip(p, p[1:], strict=False)}
        if any(a != SPACE and b == SPACE for a, b in inner):
            raise ValueError("only models whose pieces hold spaces at their start are supported")
        self.inner = np.array(sorted((ord(a) << 21) | ord(b) for a, b in inner), np.int64)
        #: The same pairs as a table, for the characters that most text is made of.
        self.common = np.zeros(LOW * LOW, bool)
        self.common[[ord(a) * LOW + ord(b) for a, b in inner if ord(a) < LOW > ord(b)]] = True

    @staticmethod
    @cache
    def of(path: str) -> Pieces:
        return Pieces(path)

    def joined(self, points: np.ndarray) -> np.ndarray:
        """Whether each character and the one before it stand side by side in some piece."""
        a, b = points[:-1], points[1:]
        low = (a < LOW) & (b < LOW)
        out = self.common[np.where(low, a * LOW + b, 0)]
        rest = np.flatnonzero(~low)
        pair = (a[rest] << 21) | b[rest]
        out[rest] = self.inner[np.minimum(np.searchsorted(self.inner, pair), len(self.inner) - 1)] == pair
        return out

    def single(self, char: str) -> list[int]:
        """Ids of a character that no longer piece covers."""
        if char in self.normal:
            return [self.normal[char][0]]
        return [self.byte[b] for b in char.encode()] if self.byte else [self.unknown]

    def ids(self, unit: str, cuts: int) -> list[int]:
        """Ids of ``unit`` cut at the set bits of ``cuts``."""
        out, begin = [], 0
        for end in range(1, len(unit) + 1):
            if cuts >> end & 1:
                part = unit[begin:end]
                out += [self.normal[part][0]] if end - begin > 1 else self.single(part)
                begin = end
        return out

    def long(self, unit: str) -> list[int]:
        """Ids of a unit beyond ``UNIT`` characters: the same merges, best first, from a heap."""
        import heapq

        if self.unigram:
            return self.viterbi(unit)
        parts: list[str | None] = list(unit)
        after, before = list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int) -> None:
            b = after[a] if a >= 0 else len(parts)
            if a >= 0 and b < len(parts) and (piece := parts[a] + parts[b]) in self.normal:
                heapq.heappush(heap, (-self.normal[piece][1], a, b, piece))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, a, b, piece = heapq.heappop(heap)
            if parts[a] is None or after[a] != b or parts[b] is None or parts[a] + parts[b] != piece:
                continue
            parts[a], parts[b], after[a] = piece, None, after[b]
            if after[b] < len(parts):
                before[after[b]] = a
            offer(before[a])
            offer(a)
        return [i for p in parts if p is not None for i in ([self.normal[p][0]] if len(p) > 1 else self.single(p))]

    def viterbi(self, unit: str) -> list[int]:
        floor = min(s for _, s in self.normal.values()) - 10
        score, back = [0.0], [0]
        for end in range(1, len(unit) + 1):
            options = [(score[b] + (self.normal[p][1] if p in self.normal else floor), b) for b in range(max(0, end - self.longest), end) if (p := unit[b:end]) in self.normal or end - b == 1]
            top = max(options, key=lambda x: (x[0], -x[1]))
            score.append(top[0])
            back.append(top[1])
        cuts, at = [], len(unit)
        while at:
            cuts.append((back[at], at))
            at = back[at]
        return [i for a, b in reversed(cuts) for i in ([self.normal[unit[a:b]][0]] if b - a > 1 else self.single(unit[a]))]


class Units:
    """The units of a slice of texts: distinct ones, and where each text's lie."""

    def __init__(self, texts: pa.Array, pieces: Pieces):
        import pyarrow.compute as pc

        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        chunks, self.codes, self.rows = chunked(texts, spaces=True)
        whole = "".join(chunks).replace(" ", SPACE)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        firsts = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(c) for c in chunks])]).astype(np.int64)
        cut = np.ones(len(points), bool)
        if len(points) > 1:
            cut[1:] = ~pieces.joined(points)
            cut[firsts[:-1]] = True
        starts = np.flatnonzero(cut)
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        bytes_at = np.concatenate([np.zeros(1, np.int64), np.cumsum(width)]).astype(np.int64)
        bounds = bytes_at[np.append(starts, len(points))]
        made = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(whole.encode())]).dictionary_encode()
        self.distinct = made.dictionary.cast(pa.string())
        #: Units of chunk c: ``of[first[c] : first[c + 1]]``.
        self.of, self.first = made.indices.to_numpy().astype(np.int64), np.searchsorted(starts, firsts)

    def ids(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end and their bounds, from those of the distinct units."""
        each = np.diff(self.first)
        units = self.of[gather(self.first[:-1], each, self.codes)]
        sizes = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths[units])])
        chunks = np.concatenate([np.zeros(1, np.int64), np.cumsum(each[self.codes])])
        return flat[gather(np.cumsum(lengths) - lengths, lengths, units)], sizes[chunks[self.rows]]


def distinct_units(docs: DataFrame, path: str) -> DataFrame:
    """unit: every distinct unit of two to ``UNIT`` characters."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in slices(batches, limit=GATHERED):
            found = Units(column(batch, "text"), Pieces.of(path)).distinct
            size = pc.utf8_length(found)
            yield pa.RecordBatch.from_arrays([found.filter(pc.and_(pc.greater(size, 1), pc.less_equal(size, UNIT)))], schema=_UNITS)

    return docs.select("text").mapInArrow(work, ddl(_UNITS)).distinct()


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """unit, edges: (order, start, ends, inner, and for a unigram model size, score) of every piece in it, best first.

    ``ends`` has the bits of an edge's two ends, ``inner`` those between. A unit without a piece of
    two characters keeps one edge that fits nowhere.
    """
    spark = units.sparkSession
    table = [(p, float(s)) for p, (_, s) in pieces.normal.items() if len(p) > 1 or pieces.unigram]
    schema = T.StructType([T.StructField("piece", T.StringType()), T.StructField("score", T.DoubleType())])
    known = spark.createDataFrame([*table, ("", 0.0)], schema)
    # A unit has two characters at least. Where the first begins, width 0 gives the edge that fits nowhere.
    shortest = 1 if pieces.unigram else 2
    begins = units.select("unit", F.explode(F.sequence(F.lit(1), F.length("unit") + 1 - shortest)).alias("b"))
    widths = F.sequence(F.when(F.col("b") == 1, 0).otherwise(shortest), F.least(F.lit(pieces.longest), F.length("unit") - F.col("b") + 1))
    spans = begins.select("unit", "b", F.explode(widths).alias("w"))
    parts = spans.select("unit", "b", "w", F.substring("unit", F.col("b"), F.col("w")).alias("piece"))
    start, end = F.col("b") - 1, F.col("b") - 1 + F.col("w")
    ends = F.when(F.col("w") == 0, F.lit(-1).cast("long")).otherwise(_bit(start).bitwiseOR(_bit(end)))
    inner = F.when(F.col("w") == 0, F.lit(0).cast("long")).otherwise(_bit(end) - F.lit(2).cast("long") * _bit(start))
    fields = [(-F.col("score")).alias("order"), start.alias("start"), ends.alias("ends"), inner.alias("inner")]
    edge = F.struct(*fields, *([F.col("w").alias("size"), F.col("score").alias("score")] if pieces.unigram else []))
    # The piece table is the vocabulary: its size is the model's, whatever the corpus.
    return parts.join(F.broadcast(known), "piece").select("unit", edge.alias("edge")).groupBy("unit").agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def merges(edges: str = "edges") -> Column:
    """The cuts of a unit under a byte-pair model, as bits: in each step the best edge over two neighbours goes.

    An edge spans two neighbours when both its ends are cuts and one cut lies between them.
    """
    n = F.length("unit")
    every = _bit(n + 1) - 1

    def step(cuts: Column, _: Column) -> Column:
        fits = F.filter(
            edges,
            lambda e: (cuts.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(cuts.bitwiseAND(e["inner"])) == 1),
        )
        return F.coalesce(cuts.bitwiseAND(F.bitwise_not(F.get(fits, F.lit(0))["inner"])), cuts)

    return F.aggregate(F.sequence(F.lit(1), n - 1), every, step)


def viterbi(edges: str = "edges", floor: float = -1e9) -> Column:
    """The cuts of a unit under a unigram model, as bits: the best total score up to each character.

    The state holds, per character, the score and the cuts of the best way there. Characters that
    are no piece cost ``floor``; ties go to the longer last piece.
    """
    n = F.length("unit")
    kind = "array<struct<score:double,cuts:bigint>>"
    begin = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("cuts"))).cast(kind)

    def step(ways: Column, end: Column) -> Column:
        alone = F.struct((F.element_at(ways, end)["score"] + floor).alias("score"), (-end).alias("start"), F.element_at(ways, end)["cuts"].alias("cuts"))
        options = F.transform(
            F.filter(edges, lambda e: (e["size"] > 0) & (e["start"] + e["size"] == end)),
            lambda e: F.struct((F.element_at(ways, e["start"] + 1)["score"] + e["score"]).alias("score"), (-e["start"] - 1).alias("start"), F.element_at(ways, e["start"] + 1)["cuts"].alias("cuts")),
        )
        top = F.array_max(F.concat(options, F.array(alone)))
        return F.concat(ways, F.array(F.struct(top["score"].alias("score"), top["cuts"].bitwiseOR(_bit(end)).alias("cuts")).cast("struct<score:double,cuts:bigint>")))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), n), begin, step), -1)["cuts"]


def unit_table(docs: DataFrame, path: str) -> DataFrame:
    """unit, ids: the pieces of every distinct unit, written once."""
    pieces = Pieces.of(path)
    units = distinct_units(docs, path)
    floor = min(s for _, s in pieces.normal.values()) - 10
    fold = viterbi(floor=floor) if pieces.unigram else merges()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Pieces.of(path)
        for batch in batches:
            names, cuts = column(batch, "unit"), column(batch, "cuts").to_pylist()
            yield to_batch(_TABLED, unit=names, ids=[vocabulary.ids(n, c) for n, c in zip(names.to_pylist(), cuts, strict=True)])

    return written(lattice(units, pieces).select("unit", fold.alias("cuts")).mapInArrow(named, ddl(_TABLED)), "units")


def _ragged(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values laid end to end, and the number of each list."""
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _all(units: Units, pieces: Pieces, tabled) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the distinct units; ``tabled(names)`` has those in the table."""
    names = units.distinct.to_pylist()
    sizes = np.array([len(n) for n in names], np.int64)
    inside = (sizes > 1) & (sizes <= UNIT)
    others = [pieces.single(names[i]) if sizes[i] == 1 else pieces.long(names[i]) for i in np.flatnonzero(~inside)]
    flat, lengths = tabled([names[i] for i in np.flatnonzero(inside)])
    counts = np.zeros(len(names), np.int64)
    counts[inside], counts[~inside] = lengths, [len(o) for o in others]
    starts = np.empty(len(names), np.int64)
    starts[inside] = np.cumsum(lengths) - lengths
    starts[~inside] = len(flat) + np.cumsum(counts[~inside]) - counts[~inside]
    both = np.concatenate([flat.astype(np.int32), np.array([i for o in others for i in o], np.int32)])
    return both[gather(starts, counts, np.arange(len(names)))], counts


def _sent(table: DataFrame):
    """A function for tasks: the ids of units, from arrays sorted by a hash that every task has.

    None if two units share a hash.
    """
    found = table.select(F.xxhash64("unit").alias("key"), "ids").toArrow().combine_chunks()
    keys = found.column("key").to_numpy().view(np.uint64)
    lists = found.column("ids").combine_chunks()
    flat, lengths = _ragged(lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists) if len(found) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    order = np.argsort(keys)
    if (np.diff(keys[order]) == 0).any():
        return None
    starts = (np.cumsum(lengths) - lengths)[order]
    shared = table.sparkSession.sparkContext.broadcast((keys[order], starts.astype(np.uint32), lengths[order].astype(np.uint8), flat.astype(np.uint16 if flat.max(initial=0) < 1 << 16 else np.int32)))

    def tabled(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known, starts, lengths, flat = shared.value
        # The hash of the column function: the same algorithm, with its seed.
        at = np.searchsorted(known, np.array([xxhash.xxh64_intdigest(n, 42) for n in names], np.uint64))
        counts = lengths[at].astype(np.int64)
        return flat[gather(starts[at].astype(np.int64), counts, np.arange(len(at)))], counts

    return tabled


def _over(docs: DataFrame, path: str, schema: pa.Schema, make, sent_units: int) -> DataFrame:
    """``make(batch, ids, bounds, pieces)`` over slices of documents with the ids of their texts."""
    table = unit_table(docs, path)
    tabled = _sent(table) if table.count() <= sent_units else None
    if tabled is not None:

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = Pieces.of(path)
            for batch in slices(batches, limit=SLICE):
                units = Units(column(batch, "text"), pieces)
                yield make(batch, *units.ids(*_all(units, pieces, tabled)), pieces)

        return docs.mapInArrow(work, ddl(schema))
    # Beyond that, documents are dealt into groups of bounded size, and each group gets its own units.
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(cores(docs.sparkSession), int(size // GROUP_BYTES) + 1)
    dealt = docs.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(groups)))

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in slices(batches):
            group = numbers(batch, "grp")
            for g in np.unique(group):
                found = Units(column(batch, "text").filter(pa.array(group == g)), Pieces.of(path)).distinct
                length = pc.utf8_length(found)
                found = found.filter(pc.and_(pc.greater(length, 1), pc.less_equal(length, UNIT)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), g)), found], names=["grp", "unit"])

    asked = dealt.select("grp", "text").mapInArrow(used, "grp long, unit string").distinct().join(table, "unit")

    def joined(texts, units):
        pieces = Pieces.of(path)
        known = dict(zip(units.column("unit").to_pylist(), units.column("ids").to_pylist(), strict=True))

        def tabled(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
            lists = [known[n] for n in names]
            return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)

        made = []
        for part in slices(texts.select(["doc_id", "text"]).combine_chunks().to_batches()):
            found = Units(column(part, "text"), pieces)
            made.append(make(part, *found.ids(*_all(found, pieces, tabled)), pieces))
        return pa.Table.from_batches(made, schema)

    return dealt.groupBy("grp").cogroup(asked.groupBy("grp")).applyInArrow(joined, ddl(schema))


def encode(docs: DataFrame, path: str, sent_units: int = SENT_UNITS) -> DataFrame:
    """doc_id, ids: the pieces of every whole text. An empty or null text has none.

    One row per row of ``docs``; rows that repeat a doc_id stay, other columns are left out.
    """

    def make(batch, ids, bounds, pieces):
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))], schema=_IDS)

    return _over(texts_of(docs), path, _IDS, make, sent_units)


def text_of(ids: np.ndarray, pieces: Pieces) -> str:
    """The text of ``ids``, without the space that encoding put before it."""
    out = b"".join([pieces.bytes[i] for i in ids.tolist()]).replace(SPACE.encode(), b" ").decode("utf-8", "replace")
    return out[1:] if out.startswith(" ") else out


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids. Null ids give a null text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else text_of(np.array(x, np.int64), Pieces.of(path)) for x in column(batch, "ids").to_pylist()]
            yield to_batch(schema, doc_id=column(batch, "doc_id"), text=texts)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(work, ddl(schema))


def checked(docs: DataFrame, path: str, sent_units: int = SENT_UNITS) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), and
    whether decoding gives the text back, where U+2581 is a space."""

    def make(batch, ids, bounds, pieces):
        spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        wire = ids.astype("<u4")
        texts = column(batch, "text").to_pylist()
        same = [text_of(ids[a:b], pieces) == t.replace(SPACE, " ") for (a, b), t in zip(spans, texts, strict=True)]
        return to_batch(_CHECKED, doc_id=column(batch, "doc_id"), n_pieces=np.diff(bounds), ids_crc32=[zlib.crc32(wire[a:b]) for a, b in spans], round_trip=same)

    return _over(texts_of(docs), path, _CHECKED, make, sent_units)
