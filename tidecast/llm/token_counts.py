"""Exact token counts at every prefix of a text, by dynamic programming over its bytes.

Byte-pair encoding has one way to cut a string in which every two neighbours stay as they are when
encoded together. So the last token of a prefix is the one suffix of it that is in the vocabulary
and that stays apart from the last token of the prefix before that suffix; the count is that
prefix's count plus one. Counts of one word are kept for every byte, words that start alike share
their prefixes, and a text's counts follow by addition, so a truncation or a budget is looked up
and nothing is encoded again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidecast.llm.common import column, gather, offsets, slices, sums, texts_of, to_batch
from tidecast.llm.packing import ddl
from tidecast.llm.tokens import ChunkTable, chunked

LIMIT = 512
#: Pairs of tokens whose verdict a Python worker keeps.
KEPT_PAIRS = 1_000_000
#: The pre-tokenizer's pattern, and those of its contractions whose own beginnings
#: are cut in another way (the mark, then the first letter).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PrefixCounts(ChunkTable):
    """For each chunk the number of tokens of each of its prefixes, a value per byte."""

    kind = np.int32

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        letters, vocabulary = byte_letters(), stored["model"]["vocab"]
        self.special = [t["content"] for t in stored["added_tokens"] if t["special"]]
        self.order: dict[bytes, int] = {bytes(map(letters.__getitem__, t)): i for t, i in vocabulary.items() if t not in self.special}
        self.longest = [0] * 256
        for token in self.order:
            self.longest[token[-1]] = max(self.longest[token[-1]], len(token))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.pattern, self.space = regex.compile(PATTERN), regex.compile(r"\s+")
        self.cuts = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def merged(self, data: bytes) -> list[bytes]:
        """Plain encoding of a short string: the earliest merge first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.order.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            first = min(ranks)
            if first == 1 << 60:
                break
            at = ranks.index(first)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens side by side are their own encoding."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = left + right not in self.order and self.merged(left + right) == [left, right]
            self.pairs[left, right] = found
        return found

    def learn(self, words: list[str]) -> None:
        """Counts of every byte prefix of each word (a pre-token), in ``self.words``."""
        order, longest, apart = self.order, self.longest, self.apart
        last: list[bytes] = [b""]
        counts = [0]
        before = b""
        for word in sorted({w for w in words if w not in self.words}):
            data = word.encode()
            same = 0
            for same, (a, b) in enumerate(zip(before, data, strict=False)):  # noqa: B007
                if a != b:
                    break
            else:
                same = min(len(before), len(data))
            del last[same + 1 :], counts[same + 1 :]
            for end in range(same + 1, len(data) + 1):
                for size in range(min(end, longest[data[end - 1]]), 0, -1):
                    token = data[end - size : end]
                    if token in order and (size == end or apart(last[end - size], token)):
                        last.append(token)
                        counts.append(counts[end - size] + 1)
                        break
            self.words[word] = counts[1:]
            before = data

    def pretokens(self, chunk: str) -> list[str]:
        if chunk[0] == " " and chunk[1:].isalpha():
            return [chunk]
        return self.pattern.findall(chunk) + self.space.findall(chunk)

    def plain(self, text: str) -> list[int]:
        """Counts at every byte prefix of a chunk without special tokens."""
        out: list[int] = []
        for word in self.pattern.findall(text):
            base = out[-1] if out else 0
            counts = self.words[word]
            if word in LONG_CONTRACTIONS:
                counts = [1, 2, counts[2]]
            out += [base + c for c in counts]
        # A prefix that ends in white space has all of it as one pre-token; the text may not.
        for run in self.space.finditer(text):
            at = len(text[: run.start()].encode())
            base = out[at - 1] if at else 0
            counts = self.words[run.group()]
            out[at : at + len(counts)] = [base + c for c in counts]
        return out

    def chunk(self, text: str) -> list[int]:
        if self.cuts is None or not (found := list(self.cuts.finditer(text))):
            return self.words[text] if text in self.words else self.plain(text)
        out: list[int] = []
        begin = 0
        for match in [*found, None]:
            part = text[begin : match.end() if match else len(text)]
            self.learn(self.pretokens(part) if part else [])
            base, counts = out[-1] if out else 0, self.plain(part)
            if match:  # its string is ordinary text until it is whole
                ahead = text[begin : match.start()]
                self.learn(self.pretokens(ahead) if ahead else [])
                counts[-1] = (self.plain(ahead) or [0])[-1] + 1
                begin = match.end()
            out += [base + c for c in counts]
        return out

    def make(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self.words = {}
        self.learn([w for c in chunks for w in self.pretokens(c)])
        found = [self.chunk(c) for c in chunks]
        self.words = {}
        lengths = np.array([len(x) for x in found], np.int64)
        return np.fromiter((c for x in found for c in x), np.int32, int(lengths.sum())), lengths


class Prefixes:
    """Counts of the texts of one slice."""

    def __init__(self, batch: pa.RecordBatch, path: str):
        texts = column(batch, "text")
        chunks, self.codes, self.rows = chunked(texts)
        self.bytes = np.diff(offsets(texts))
        self.flat, self.starts, self.lengths = PrefixCounts.of(path).table(chunks)
        totals = self.flat[self.starts + self.lengths - 1].astype(np.int64)
        each = totals[self.codes]
        self.tokens = sums(each, self.rows)
        row = np.repeat(np.arange(len(self.tokens)), np.diff(self.rows))
        running = np.cumsum(each) - each
        self.before = running - running[self.rows[:-1][row]] if len(each) else running

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts at every byte prefix of every text, and each text's bounds."""
        values = self.flat[gather(self.starts, self.lengths, self.codes)] + np.repeat(self.before, self.lengths[self.codes])
        return values, np.concatenate([np.zeros(1, np.int64), np.cumsum(self.bytes)])

    def cut(self, batch: pa.RecordBatch, limit: int) -> np.ndarray:
        """Bytes of each text's longest prefix, of whole characters, with ``limit`` tokens at most."""
        out = self.bytes.copy()
        texts = column(batch, "text")
        spans = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.lengths[self.codes])])
        for i in np.flatnonzero(self.tokens > limit):
            a, b = self.rows[i], self.rows[i + 1]
            # Every prefix of a chunk has a token at least, so the cut lies in the last chunk that starts below the limit.
            at = a + int(np.searchsorted(self.before[a:b], limit, side="left")) - 1
            begin = int(spans[at] - spans[a])
            if limit <= 0:
                out[i] = 0
                continue
            code = self.codes[at]
            counts = self.before[at] + self.flat[self.starts[code] : self.starts[code] + self.lengths[code]]
            data = texts[i].as_buffer()[begin : begin + len(counts) + 1]
            whole = np.array([j + 1 == len(data) or data[j + 1] & 0xC0 != 0x80 for j in range(len(counts))])
            fits = np.flatnonzero((counts <= limit) & whole)
            out[i] = begin + (int(fits[-1]) + 1 if len(fits) else 0)
        return out


_BUDGET = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("cut_bytes", pa.int64())]
)
_TABLE = pa.schema([("doc_id", pa.int64()), ("counts", pa.list_(pa.int32()))])


def budgets(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Answers from every text's prefix counts: its size, whether it is over ``limit``, where to cut it.

    doc_id, n_bytes, n_tokens, over_limit, and cut_bytes, the bytes of the longest prefix of whole
    characters with at most ``limit`` tokens. One row per row of ``docs``; a null text is empty, a
    null or repeated doc_id stays as it is, other columns are left out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = Prefixes(batch, path)
            yield to_batch(
                _BUDGET, doc_id=column(batch, "doc_id"), n_bytes=found.bytes, n_tokens=found.tokens, over_limit=found.tokens > limit, cut_bytes=found.cut(batch, limit)
            )

    return texts_of(docs).mapInArrow(work, ddl(_BUDGET))


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and counts: the tokens of the text's first 1, 2, ... bytes; empty for an empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            values, bounds = Prefixes(batch, path).all()
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), lists], schema=_TABLE)

    return texts_of(docs).mapInArrow(work, ddl(_TABLE))
