"""Token ids of many texts from the ``tokenizers`` library, encoding each distinct chunk once.

A chunk is a run of white space and the word after it. Pre-tokenizers of the byte-level and the
word-end vocabularies never let a token reach from a word into the white space that follows, so a
text's ids are its chunks' ids in order. Invented and rare words are most of the distinct chunks,
common words most of the occurrences: the work is done per distinct chunk of a slice, and a
bounded table of chunks is kept between slices.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from tidecast.llm.common import column, gather, offsets

#: Chunks a Python worker keeps between slices.
KEPT_CHUNKS = 400_000
#: Chunks encoded as one text.
JOINED = 500
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CONTROL = np.zeros(256, bool)
_CONTROL[28:32] = True


def chunked(texts: pa.Array, spaces: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct chunks of ``texts``, the code of each chunk in order, and each text's first chunk.

    A chunk starts at ASCII white space, with ``spaces`` at a space only, after a character that is
    no white space of any kind.
    """
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return [], np.zeros(0, np.int64), np.zeros(1, np.int64)
    bounds = offsets(texts)
    begin = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[begin : begin + bounds[-1]]
    at = np.flatnonzero(data == 32 if spaces else _SPACE[data])
    # Only the few bytes before white space are looked at: whether the character there may be white space too.
    one, two, three = (data[np.maximum(at - n, 0)] for n in (1, 2, 3))
    blank = _SPACE[one] | _CONTROL[one] | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three >= 0xE1) & (three <= 0xE3))
    # Every text that is not empty starts a chunk, whatever the text before ends with.
    first = np.zeros(len(data), bool)
    first[at[~blank]] = True
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(data)).astype(np.int64)
    cuts = np.concatenate([starts, ends[-1:]]) if len(starts) else np.zeros(1, np.int64)
    pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data.tobytes())])
    pieces = pieces.dictionary_encode()
    return pieces.dictionary.to_pylist(), pieces.indices.to_numpy().astype(np.int64), np.searchsorted(starts, bounds)


class ChunkTable:
    """Values of chunks, made once for each distinct chunk: ``make`` gives those of new chunks."""

    _own: dict[tuple[type, str], ChunkTable] = {}
    kind = np.uint32

    def __init__(self, path: str):
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, self.kind)
        self.starts = self.lengths = np.zeros(0, np.int64)

    @classmethod
    def of(cls, path: str):
        """The one of this Python worker."""
        if (cls, path) not in cls._own:
            cls._own[cls, path] = cls(path)
        return cls._own[cls, path]

    def make(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Values of ``chunks`` laid end to end, and the number of each."""
        raise NotImplementedError

    def table(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values, and each chunk's start and number of values in them."""
        at = np.array([self.known.get(c, -1) for c in chunks], np.int64)
        new = np.flatnonzero(at < 0)
        flat, counts = self.make([chunks[i] for i in new])
        begin, seen = len(self.flat), len(self.starts)
        both = np.concatenate([self.flat, flat])
        starts = np.concatenate([self.starts, begin + np.cumsum(counts) - counts])
        lengths = np.concatenate([self.lengths, counts])
        at[new] = seen + np.arange(len(new))
        room = max(0, KEPT_CHUNKS - seen)
        if room and len(new):
            self.known.update((chunks[i], seen + j) for j, i in enumerate(new[:room]))
            self.starts, self.lengths = starts[: seen + room].copy(), lengths[: seen + room].copy()
            self.flat = both[: self.starts[-1] + self.lengths[-1]].copy()
        return both, starts[at], lengths[at]


class Encoder(ChunkTable):
    """Token ids."""

    def __init__(self, path: str):
        super().__init__(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def make(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joinable = [i for i, c in enumerate(chunks) if c[0] in "\t\n\v\f\r " and not c[-1].isspace()]
        alone = sorted(set(range(len(chunks))) - set(joinable))
        groups = [joinable[i : i + JOINED] for i in range(0, len(joinable), JOINED)] + [[i] for i in alone]
        order, counts, ids = [], [], []
        texts = ["".join([chunks[i] for i in g]) for g in groups]
        for group, made in zip(groups, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            order += group
            ids.append(np.array(made.ids, np.uint32))
            if len(group) == 1:
                counts.append(np.array([len(made.ids)]))
            else:
                begins = np.cumsum([0, *[len(chunks[i]) for i in group[:-1]]])
                at = np.array([a for a, _ in made.offsets], np.int64)
                counts.append(np.bincount(np.searchsorted(begins, at, side="right") - 1, minlength=len(group)))
        order, counts = np.array(order, np.int64), np.concatenate(counts or [np.zeros(0, np.int64)])
        flat = np.concatenate(ids or [np.zeros(0, np.uint32)])
        back = np.argsort(order)
        return flat[gather(np.cumsum(counts) - counts, counts, back)], counts[back]


def token_ids(batch: pa.RecordBatch, path: str, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a slice laid end to end, and each text's bounds; ``end`` closes each text."""
    chunks, codes, rows = chunked(column(batch, "text"))
    flat, starts, lengths = Encoder.of(path).table(chunks)
    ids = flat[gather(starts, lengths, codes)]
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths[codes])])[rows]
    if end is not None:
        ids = np.insert(ids, bounds[1:], np.uint32(end))
        bounds = bounds + np.arange(len(bounds))
    return ids, bounds
