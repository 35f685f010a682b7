"""Document quality from its lines: a linear-chain conditional random field.

Every line is good or bad. A line's features describe its characters and words and those of the
lines next to it; neighbouring labels depend on each other. Forward-backward gives each line's
chance of being good, the lengths of the lines weight their mean, and a logistic curve fitted on
the training rows turns it into the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import bounded, coded, column, slices, sums, texts_of, to_batch
from tidecast.llm.langid import held_out
from tidecast.llm.packing import ddl

#: Labelled documents learned from, by the order of a hash of doc_id.
SAMPLE = 6000
#: Of a document learned from: lines of a window, and windows, evenly spaced.
WINDOW, WINDOWS = 64, 4
STEPS, RATE, RIDGE = 250, 0.1, 1e-3
#: Text handled at once: every character becomes a few numbers.
SLICE = 2 << 20
CLASSES = 7  # other, lower, upper, digit, space, stop, symbol

_LINES = pa.schema([("label", pa.int32()), ("lengths", pa.list_(pa.int32())), ("features", pa.binary())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_lines", pa.int32())])


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        x = chr(c)
        out[c] = 1 if x.islower() else 2 if x.isupper() else 3 if x.isdigit() else 4 if x.isspace() else 0
    for x in ".,;:'\"()-":
        out[ord(x)] = 5
    for x in "!?*#$%&|@<>{}[]=+~^_\\/`":
        out[ord(x)] = 6
    return out


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of every text, the lines' lengths (with the line end) and each text's first line."""
    split = pc.split_pattern(texts, "\n")
    lines, rows = split.flatten(), np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
    size = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    points = np.frombuffer(("\n".join(lines.to_pylist()) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    cells = np.repeat(np.arange(len(lines), dtype=np.int64) * CLASSES, size)
    cells += classes()[points]
    kinds = np.bincount(cells, minlength=len(lines) * CLASSES).reshape(-1, CLASSES).astype(np.float64)
    words, codes, bounds = coded(pc.ascii_split_whitespace(lines))
    n = np.diff(bounds)
    line = np.repeat(np.arange(len(lines)), n)
    again = np.zeros(len(codes), np.int64)
    again[1:] = (codes[1:] == codes[:-1]) & (line[1:] == line[:-1])
    distinct = np.bincount(np.unique(line * max(1, len(words)) + codes) // max(1, len(words)), minlength=len(lines))
    letters = np.maximum(1, kinds[:, 1] + kinds[:, 2])
    share = kinds / size[:, None]
    some = np.maximum(1, n)
    repeated = sums(again, bounds) / some
    shout, marks = kinds[:, 2] / letters, share[:, 6]
    own = np.column_stack(
        [
            shout, marks, share[:, 3], share[:, 5] * 5, repeated, distinct / some, np.minimum(3, letters / some / 8), np.log1p(size) / 8,
            shout > 0.5, marks > 0.04, repeated > 0.25, kinds[:, 6] / some, size == 1,
        ]
    ).astype(np.float32)
    first, last = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
    first[rows[:-1]], last[rows[1:] - 1] = True, True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[last] = 0, 0
    return np.column_stack([np.ones(len(lines)), own, before, after, first, last]).astype(np.float32), size, rows


def forward_backward(logits: np.ndarray, rows: np.ndarray, jump: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's chance of being good, and the expected number of each pair of neighbouring labels.

    ``jump``: log weights of the pairs. Chains advance together, one line a step, longest first.
    """
    lengths = np.diff(rows)
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = rows[:-1][order], lengths[order]
    logits = np.clip(logits, -30, 30)
    local = np.column_stack([1 / (1 + np.exp(logits)), 1 / (1 + np.exp(-logits))])
    move = np.exp(jump)
    longest = int(lengths.max(initial=0))
    live = np.searchsorted(-lengths, -np.arange(longest), side="left")  # chains with more than t lines
    ahead, back = np.empty_like(local), np.ones_like(local)
    for t in range(longest):
        at = begins[: live[t]] + t
        now = local[at] if t == 0 else local[at] * (ahead[at - 1] @ move)
        ahead[at] = now / now.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        at = begins[: live[t]] + t
        out = local[at] * back[at]
        joint = ahead[at - 1][:, :, None] * move[None] * out[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        earlier = out @ move.T
        back[at - 1] = earlier / earlier.sum(axis=1, keepdims=True)
    both = ahead * back
    return both[:, 1] / both.sum(axis=1), pairs


@dataclass
class Model:
    weights: np.ndarray
    jump: np.ndarray
    slope: float
    shift: float

    def raw(self, features: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' chances, as log odds."""
        good, _ = forward_backward(features @ self.weights, rows, self.jump)
        mean = sums(good * sizes, rows) / sums(sizes, rows)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        features, sizes, rows = line_features(texts)
        x = self.slope * self.raw(features, sizes.astype(np.float64), rows) + self.shift
        return 1 / (1 + np.exp(-x)), np.diff(rows)


def _ascend(parameters: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    """Maximise by gradient steps with running moments."""
    mean, square = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, steps + 1):
        g = gradient(parameters)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        parameters = parameters + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return parameters


def fit(features: np.ndarray, sizes: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> Model:
    """Conditional likelihood of the lines' labels, each line's being its chain's, then the curve."""
    width, chains = features.shape[1], np.diff(rows)
    truth = np.repeat(labels, chains).astype(np.float64)
    kept = np.array([(chains[labels == v] - 1).sum() for v in (0, 1)], np.float64)
    observed = np.diag(kept)

    def gradient(p: np.ndarray) -> np.ndarray:
        good, pairs = forward_backward(features @ p[:width], rows, p[width:].reshape(2, 2))
        g = np.concatenate([features.T @ (truth - good), (observed - pairs).ravel()])
        return g / len(truth) - RIDGE * p

    p = _ascend(np.zeros(width + 4), gradient, STEPS, RATE)
    model = Model(p[:width], p[width:].reshape(2, 2), 1.0, 0.0)
    x = model.raw(features, sizes.astype(np.float64), rows)

    def curve(p: np.ndarray) -> np.ndarray:
        error = labels - 1 / (1 + np.exp(-(p[0] * x + p[1])))
        return np.array([(error * x).mean(), error.mean()]) - RIDGE * p

    model.slope, model.shift = map(float, _ascend(np.array([1.0, 0.0]), curve, 200, 0.05))
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents that are not held out, by a hash of doc_id.

    A document with several labels counts once, with the lowest. Without both classes every score
    is the share of good documents (one half without any).
    """
    usable = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    picked = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = bounded(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            features, sizes, rows = line_features(column(batch, "text"))
            for i, label in enumerate(column(batch, "label").to_pylist()):
                count = -(-(rows[i + 1] - rows[i]) // WINDOW)
                for w in sorted({round(x) for x in np.linspace(0, count - 1, min(count, WINDOWS))}):
                    a = rows[i] + w * WINDOW
                    b = min(a + WINDOW, rows[i + 1])
                    yield to_batch(_LINES, label=[label], lengths=[sizes[a:b].astype(np.int32)], features=[features[a:b].tobytes()])

    got = texts.select("text", "label").mapInArrow(work, ddl(_LINES)).toArrow()
    answers = got.column("label").to_numpy()
    width = line_features(pa.array([""]))[0].shape[1]
    if len(set(answers)) < 2:
        share = float(np.clip(answers.mean() if len(answers) else 0.5, 0.01, 0.99))
        return Model(np.zeros(width), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    lengths = [np.array(x) for x in got.column("lengths").to_pylist()]
    order = sorted(range(len(answers)), key=lambda i: (int(answers[i]), got.column("features")[i].as_py()))  # the same fit on every run
    features = np.concatenate([np.frombuffer(got.column("features")[i].as_py(), np.float32).reshape(-1, width) for i in order])
    rows = np.concatenate([[0], np.cumsum([len(lengths[i]) for i in order])]).astype(np.int64)
    return fit(features.astype(np.float64), np.concatenate([lengths[i] for i in order]), rows, answers[order])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines: one row per row of ``docs``.

    A null or empty text is one empty line and scored as such.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            score, lines = shared.value.score(column(batch, "text"))
            yield to_batch(_SCORED, doc_id=column(batch, "doc_id"), score=score, predicted=(score >= 0.5).astype(np.int32), n_lines=lines.astype(np.int32))

    return texts_of(docs).mapInArrow(work, ddl(_SCORED)).select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_lines")


def good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is one half or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch.set_column(batch.schema.get_field_index("text"), "text", column(batch, "text").fill_null(""))], limit=SLICE):
                yield part.filter(pa.array(shared.value.score(column(part, "text"))[0] >= 0.5))

    return bounded(docs).mapInArrow(work, docs.schema)
