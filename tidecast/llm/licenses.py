"""License notices in documents: MinHash bands over overlapping windows, then exact containment.

Every template has windows of its own length in shingles, an eighth of it apart, over every
document. A window whose bands meet the template's is a candidate, and the share of the template's
shingles around it is counted exactly. Where a passage holds 0.8 of a template, some window shares
half of the union with it, so a window misses all ``BANDS`` bands in under 1 of 100 cases; an
unchanged notice is met for certain when windows are one shingle apart.

The templates are a small fixed list that every task has; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from tidecast.llm.common import coded, column, slices, texts_of, to_batch
from tidecast.llm.near_dups import WORDS, mix
from tidecast.llm.packing import ddl

BANDS, ROWS = 16, 2
CONTAINMENT = 0.8
#: Around a word, these do not count.
MARKS = ".,;:!?\"'()[]{}<>*#|&%$"

#: Notices as their licenses word them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "BSD grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "GPL grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}

_MATCHES = pa.schema(
    [("doc_id", pa.int64()), ("license", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]
)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of every text, lower-cased and without marks around it, and each text's first word."""
    dictionary, codes, rows = coded(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
    words = pc.utf8_trim(dictionary, characters=MARKS).to_pylist()
    real = np.array([bool(w) for w in words], bool)[codes] if words else np.zeros(0, bool)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    return hashes[codes[real]] if words else np.zeros(0, np.uint64), np.concatenate([np.zeros(1, np.int64), np.cumsum(real)])[rows]


def shingled(words: np.ndarray) -> np.ndarray:
    """A hash of the ``WORDS`` words from every place on, where there are so many."""
    out = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for i in range(WORDS):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - WORDS + 1 + i]
    return mix(out)


def minhash(shingles: np.ndarray, k: int) -> np.ndarray:
    """Each shingle's value under the ``k``-th hash."""
    flip, times = mix(np.array([2 * k + 1, 2 * k + 2], np.uint64))
    return (((shingles ^ flip) * (times | np.uint64(1))) >> np.uint64(32)).astype(np.uint32)


class Templates:
    def __init__(self, templates: dict[str, str]):
        """Templates of fewer words than a shingle has are an error: nothing could be verified."""
        self.names, self.sets, self.sizes, self.least = [], [], [], []
        for name, text in templates.items():
            shingles = shingled(word_hashes(pa.array([text]))[0])
            if not len(shingles):
                raise ValueError(f"template {name} has fewer than {WORDS} words")
            self.names.append(name)
            self.sets.append(np.unique(shingles))
            self.sizes.append(len(shingles))
            self.least.append([int(minhash(shingles, k).min()) for k in range(BANDS * ROWS)])

    def candidates(self, shingles: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
        """Per template, where windows start that share a band with it. ``inside``: shingles that lie in one text."""
        steps = [max(1, n // 8) for n in self.sizes]
        met = [np.zeros(-(-len(shingles) // s), bool) for s in steps]
        for band in range(BANDS):
            agree = [None] * len(steps)
            for k in range(band * ROWS, (band + 1) * ROWS):
                width, least = 1, np.where(inside, minhash(shingles, k), np.uint32(0xFFFFFFFF))
                for t in sorted(range(len(steps)), key=lambda t: self.sizes[t]):
                    while 2 * width <= self.sizes[t]:
                        least, width = _shorter(least, width), 2 * width
                    window = _shorter(least, self.sizes[t] - width)[:: steps[t]] == self.least[t][k]
                    agree[t] = window if agree[t] is None else agree[t] & window
            for t, a in enumerate(agree):
                met[t] |= a
        return [np.flatnonzero(m) * s for m, s in zip(met, steps, strict=True)]

    def matches(self, texts: pa.Array, share: float) -> list[tuple[int, str, int, int, float]]:
        """text, license, first and last word, containment; overlapping candidates are one match, the first of the best."""
        words, rows = word_hashes(texts)
        shingles = shingled(words)
        if not len(shingles):
            return []
        text = np.repeat(np.arange(len(texts)), np.diff(rows))
        inside = text[: len(shingles)] == text[WORDS - 1 :]
        found = []
        for t, starts in enumerate(self.candidates(shingles, inside)):
            size, slack = self.sizes[t], max(1, self.sizes[t] // 8)
            kept: list[tuple[int, str, int, int, float]] = []
            for start in starts.tolist():
                row = int(text[start])
                a, b = max(int(rows[row]), start - slack), min(int(rows[row + 1]) - WORDS + 1, start + size + slack)
                hits = np.flatnonzero(np.isin(shingles[a:b], self.sets[t]))
                part = len(np.unique(shingles[a:b][hits])) / len(self.sets[t])
                if part < share:
                    continue
                match = (row, self.names[t], int(a + hits[0] - rows[row]), int(a + hits[-1] + WORDS - 1 - rows[row]), part)
                if kept and kept[-1][0] == row and match[2] <= kept[-1][3]:
                    if part > kept[-1][4]:
                        kept[-1] = match
                else:
                    kept.append(match)
            found += kept
        return sorted(found)


def _shorter(least: np.ndarray, by: int) -> np.ndarray:
    """The smaller of each value and the one ``by`` places on."""
    if not by:
        return least
    out = least.copy()
    if by < len(least):
        np.minimum(least[:-by], least[by:], out=out[:-by])
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, share: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, start_word, end_word, containment: a row for each notice in each document.

    Words are counted from 0 and as the match sees them: lower case, split at white space, without
    marks around them; a word of marks only is none. Texts that are null, empty or shorter than a
    shingle hold no notice; rows that repeat a doc_id are scanned each. Other columns are left out.
    """
    chosen = TEMPLATES if templates is None else templates
    Templates(chosen)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(chosen)
        for batch in slices(batches):
            found = known.matches(column(batch, "text"), share)
            if found:
                row, name, start, end, part = zip(*found, strict=True)
                yield to_batch(_MATCHES, doc_id=column(batch, "doc_id").take(pa.array(row)), license=name, start_word=start, end_word=end, containment=part)

    return texts_of(docs).mapInArrow(work, ddl(_MATCHES))
