"""Language identification with interpolated Kneser-Ney models over letters.

Every language has a model of order ``ORDER`` over the letters of words, with the gap between
words as one more symbol. Counts come from all training rows; discounts, continuation counts and
back-off weights are aggregations in Spark. The finished model is a written table of exact n-grams
for each order, which grows with the corpus; the distinct n-grams of the texts are priced by joins
with it. Texts themselves are never shuffled: a slice of them is kept as its distinct words, their
distinct n-grams, and the words of every text as numbers, and meets the costs of its own n-grams. A text gets the language with the lowest cross-entropy per symbol, and is
rejected where even that is far above what the language's own text costs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.llm.common import bounded, coded, column, give_back, slices, sums, texts_of, to_batch, written
from tidecast.llm.packing import ddl

ORDER = 5
#: The symbol of the gap between words, and of the places before a word's first letter.
GAP = " "
#: Where a text is rejected: this far from its language's own cost towards a uniform guess, plus
#: this many standard deviations of the mean over its symbols.
REJECT, DEVIATIONS = 0.5, 6.0
#: Symbols that count as one independent observation when the score is formed: about a word.
WORD = 8.0
UNKNOWN = "und"
#: Text read at once; text and distinct words of a slice, whichever is reached first; letters cut into n-grams at once.
BATCH, SLICE, SLICE_WORDS, BLOCK = 3 << 20, 32 << 20, 8 << 20, 1 << 19

_GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row may not be learned from: crc32 of its doc_id as text, modulo 3, is 1. A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


@cache
def symbols() -> np.ndarray:
    """The symbol of every code point: its lower-case letter, or the gap for what is no letter."""
    out = np.full(0x110000, ord(GAP), np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = ord(chr(c).lower()[0])
    return out


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams, the n-gram that ends at every letter of every word and at every end of letters, each word's first one.

    A gram is a string of ``ORDER`` symbols; those before the letters' start are gaps.
    """
    points = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    s = symbols()[points]
    at = np.arange(len(s))
    gap = np.maximum.accumulate(np.where(s == ord(GAP), at, -1))
    before = np.append(-1, gap[:-1])  # the last gap before each place
    counted = np.flatnonzero((s != ord(GAP)) | (at - before > 1))
    found = np.zeros(0x110000, bool)
    found[s] = found[ord(GAP)] = True
    letters, number = np.flatnonzero(found), np.cumsum(found) - 1
    bits = max(1, int(len(letters) - 1).bit_length())
    symbol = number[s]
    columns = [np.where(counted - back > before[counted], symbol[counted - back], number[ord(GAP)]) for back in range(ORDER - 1, 0, -1)]
    columns.append(symbol[counted])
    # Where five symbols do not fit one number, two and three of them are numbered first.
    cuts = [columns] if bits * ORDER < 64 else [columns[:2], columns[2:]]
    coded_parts = [_numbered(_joined(part, bits)) for part in cuts]
    distinct, place = coded_parts[0]
    matrices = [_split(distinct, len(cuts[0]), bits)]
    if len(cuts) > 1:
        tails, tail = coded_parts[1]
        both, place = _numbered(place * max(1, len(tails)) + tail)
        matrices = [matrices[0][both // max(1, len(tails))], _split(tails, len(cuts[1]), bits)[both % max(1, len(tails))]]
    grams = np.ascontiguousarray(letters[np.concatenate(matrices, axis=1)].astype(np.uint32)).view(f"<U{ORDER}").ravel()
    word = np.repeat(np.arange(len(words)), np.array([len(w) + 1 for w in words], np.int64))[counted]
    return grams, place, np.searchsorted(word, np.arange(len(words) + 1))


def _joined(columns: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        out = out << bits | c
    return out


def _split(numbers: np.ndarray, n: int, bits: int) -> np.ndarray:
    return numbers[:, None] >> (bits * np.arange(n - 1, -1, -1)) & ((1 << bits) - 1)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values as they are met, and the number of each value's."""
    found = pa.array(values).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy().astype(np.int64)


def _words(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    return coded(pc.ascii_split_whitespace(column(batch, "text")))


def counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over every row of ``docs`` (text, lang); each slice of a task sends a gram once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=BATCH):
            words, codes, rows = _words(batch)
            if not len(words):
                continue
            found, place, firsts = grams_of(words.to_pylist())
            word = np.repeat(np.arange(len(words)), np.diff(firsts))
            langs = column(batch, "lang").to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(langs)), np.diff(rows))
            for lang in sorted(set(langs)):
                times = np.bincount(codes[(langs == lang)[of]], minlength=len(words))
                n = np.bincount(place, weights=times[word], minlength=len(found))
                some = np.flatnonzero(n)
                if len(some):
                    yield to_batch(_GRAMS, lang=[lang] * len(some), gram=found[some], n=n[some].astype(np.int64))

    usable = bounded(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    return usable.mapInArrow(work, ddl(_GRAMS)).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def probabilities(counted: DataFrame, order: int) -> DataFrame:
    """kind (0: discounted share of a gram, 1: back-off weight of a context), gram, lang, value of one order.

    ``counted`` holds lang, gram and c, the count or the number of symbols seen before the gram.
    """
    once, twice = (F.sum((F.col("c") == n).cast("long")).alias(name) for n, name in ((1, "n1"), (2, "n2")))
    shares = {r["lang"]: r["n1"] / (r["n1"] + 2 * r["n2"]) if r["n1"] and r["n2"] else 0.5 for r in counted.groupBy("lang").agg(once, twice).collect()}
    discount = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair]), F.col("lang"))
    every = counted.withColumn("context", F.substring("gram", 1, order - 1))
    contexts = every.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
    seen = every.join(contexts.hint("merge"), ["lang", "context"])
    return seen.select(F.lit(0).alias("kind"), "gram", "lang", ((F.col("c") - discount) / F.col("total")).alias("value")).unionByName(
        contexts.select(F.lit(1).alias("kind"), F.col("context").alias("gram"), "lang", (discount * F.col("kinds") / F.col("total")).alias("value"))
    )


@dataclass
class Judge:
    """What a task needs besides the costs of its texts' n-grams."""

    langs: list[str]
    vocabulary: int
    mean: np.ndarray | None = None
    deviation: np.ndarray | None = None

    def judge(self, cost: np.ndarray, size: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and acceptance of texts, by their costs in each language and numbers of symbols."""
        best = np.argmin(cost, axis=1)
        least = cost.min(axis=1)
        score = np.where(size > 0, 1 / np.exp(-(cost - least[:, None]) / WORD).sum(axis=1), 0.0)
        entropy = least / np.maximum(size, 1)
        mean, deviation = self.mean[best], self.deviation[best]
        most = mean + REJECT * np.maximum(0, np.log(self.vocabulary) - mean) + DEVIATIONS * deviation / np.sqrt(np.maximum(size, 1))
        names = [self.langs[b] if n else UNKNOWN for b, n in zip(best, size, strict=True)]
        return names, score, entropy, (size > 0) & (entropy <= most)


def _packed(codes: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """Each text's numbers in ascending order as steps, byte by byte of their places, compressed; bytes of a step, of all.

    The order of words does not matter to their costs, and steps are small.
    """
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    steps = np.diff(np.sort(text << 32 | codes) & 0xFFFFFFFF, prepend=0)
    firsts = ends[:-1][np.diff(ends) > 0]
    steps[firsts] += np.append(0, np.cumsum(steps))[firsts]
    width = 2 if steps.max(initial=0) < 1 << 16 else 4
    planes = steps.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return pa.Codec("zstd", compression_level=3).compress(planes, asbytes=True), width, len(planes)


def _unpacked(packed: bytes, width: int, raw: int, ends: np.ndarray) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, raw, codec="zstd", asbytes=True), np.uint8).reshape(width, -1)
    total = np.append(0, np.cumsum(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)))
    return total[1:] - np.repeat(total[ends[:-1]], np.diff(ends))


def _blocks(words: pa.Array) -> Iterator[list[str]]:
    """Runs of words of about ``BLOCK`` letters each; Python strings of one run at a time."""
    ends = np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    cuts = np.append(np.flatnonzero(np.diff(ends // BLOCK)) + 1, len(words)) if len(words) else []
    at = 0
    for to in cuts:
        yield words.slice(at, int(to) - at).to_pylist()
        at = int(to)


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def sliced(texts: DataFrame, key: str) -> DataFrame:
    """The texts as numbers of words, in slices.

    A row holds the texts of one batch: slice, their ``keys``, their numbers of ``words``, and in
    ``packed`` those words (``_packed``), in ascending order within a text. A slice has one more row
    with its distinct ``grams`` and in ``packed`` its distinct words, in the order of their numbers,
    as compressed lines of ``raw`` bytes.
    """
    kind = pa.int64() if dict(texts.dtypes)[key] == "bigint" else pa.string()
    made = pa.schema(
        [
            ("slice", pa.int64()),
            ("keys", pa.list_(kind)),
            ("words", pa.list_(pa.int64())),
            ("width", pa.int32()),
            ("raw", pa.int64()),
            ("packed", pa.binary()),
            ("grams", pa.list_(pa.string())),
        ]
    )

    def head(number: int, known: pa.Array) -> pa.RecordBatch:
        found = [pa.array(grams_of(block)[0], pa.string()) for block in _blocks(known)]
        grams = pc.unique(pa.concat_arrays(found)) if found else pa.array([], pa.string())
        raw = pc.binary_join(_one_list(known), "\n")[0].as_buffer()
        packed = pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)
        # Arrow all the way: as Python strings a slice's words and n-grams take ten times the memory, which a worker keeps.
        return to_batch(made, slice=[number], keys=[None], words=[None], width=[0], raw=[raw.size], packed=[packed], grams=_one_list(grams))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known, read = TaskContext.get().partitionId() << 32, pa.array([], pa.string()), 0
        for batch in slices(batches, limit=BATCH):
            words, codes, rows = _words(batch)
            words = words.cast(pa.string())
            place = pc.index_in(words, value_set=known)
            new = place.is_null().to_numpy(zero_copy_only=False)
            numbers = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            numbers[new] = len(known) + np.arange(int(new.sum()))
            known = pa.concat_arrays([known, words.filter(pa.array(new))])
            packed, width, raw = _packed(numbers[codes], rows)
            keys = column(batch, key).to_pylist()
            yield to_batch(made, slice=[number], keys=[keys], words=[np.diff(rows)], width=[width], raw=[raw], packed=[packed], grams=[None])
            read += max(1, int(column(batch, "text").nbytes))
            if read >= SLICE or known.nbytes >= SLICE_WORDS:
                yield head(number, known)
                number, known, read = number + 1, pa.array([], pa.string()), 0
        if read:
            yield head(number, known)

    return written(texts.select(key, "text").mapInArrow(cut, ddl(made)), "slices")


@dataclass
class Model(Judge):
    """``tables``: for each order from 1 up, a table of kind, gram and an array with a value for every language."""

    tables: list[DataFrame] = field(default_factory=list)

    def priced(self, grams: DataFrame) -> DataFrame:
        """gram, cost: for every distinct gram, the nats of its last symbol after the others, per language.

        From the shortest order up: an order's distinct n-grams meet their discounted share, the
        back-off weight of their context and what the order below gave, and are written.
        """
        below = written(grams.select("gram").distinct(), "needed")
        needed = [below]
        for order in range(ORDER - 1, 0, -1):
            needed.append(written(needed[-1].select(F.substring("gram", 2, order).alias("gram")).distinct(), f"needed-{order}"))
        shares, ones = (F.array(*[F.lit(x)] * len(self.langs)) for x in (0.0, 1.0))
        for order, table in enumerate(self.tables, 1):
            share = table.where("kind = 0").select("gram", F.col("value").alias("share"))
            weight = table.where("kind = 1").select(F.col("gram").alias("context"), F.col("value").alias("weight"))
            found = needed[ORDER - order].withColumn("context", F.substring("gram", 1, order - 1))
            found = found.join(share.hint("merge"), "gram", "left").join(weight.hint("merge"), "context", "left")
            if order == 1:
                found = found.withColumn("p", F.array(*[F.lit(1.0 / self.vocabulary)] * len(self.langs)))
            else:
                tail = F.substring("gram", 2, order - 1)
                found = found.withColumn("tail", tail).join(below.select(F.col("gram").alias("tail"), "p").hint("merge"), "tail")
            lower = F.zip_with(F.coalesce("weight", ones), "p", lambda x, y: x * y)
            below = written(found.select("gram", F.zip_with(F.coalesce("share", shares), lower, lambda x, y: x + y).alias("p")), f"priced-{order}")
        return below.select("gram", F.transform("p", lambda x: -F.log(F.greatest(x, F.lit(1e-12)))).alias("cost"))

    def costs(self, grams: list[str]) -> np.ndarray:
        """Nats of each of a few grams' last symbol after the others, per language."""
        asked = self.tables[0].sparkSession.createDataFrame([(g,) for g in sorted(set(grams))], "gram string")
        found = {r["gram"]: r["cost"] for r in self.priced(asked).collect()}
        return np.array([found[g] for g in grams])

    def judged(self, texts: DataFrame, key: str) -> DataFrame:
        """key, lang_pred, score, cross_entropy, accepted: one row per row of ``texts`` (``key``, a long or a string, and text).

        Only n-grams are joined with the model, and each slice's numbers go to one task with the costs of its n-grams.
        """
        plain = Judge(self.langs, self.vocabulary, self.mean, self.deviation)
        parts = sliced(texts, key)
        verdicts = "lang_pred string, score double, cross_entropy double, accepted boolean"
        out = T.StructType([T.StructField("key", parts.schema["keys"].dataType.elementType), *T.StructType.fromDDL(verdicts).fields])

        def meet(part: pa.Table, costs: pa.Table) -> pa.Table:
            give_back()
            some = pc.equal(part.column("width"), 0)
            (head,) = part.filter(some).to_pylist()
            part = part.filter(pc.invert(some))
            known = costs.column("gram").combine_chunks()
            values = costs.column("cost").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(costs.num_rows, len(plain.langs))
            raw = pa.decompress(head["packed"], head["raw"], codec="zstd", asbytes=True)
            words = pc.split_pattern(pa.array([raw], pa.binary()).cast(pa.string()), "\n").flatten()
            word_cost, word_size = [], []
            for block in _blocks(words):
                grams, place, firsts = grams_of(block)
                at = pc.index_in(pa.array(grams, known.type), value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)
                word_cost.append(sums(values[at[place]].astype(np.float64), firsts))
                word_size.append(np.diff(firsts))
            word_cost, word_size = np.concatenate(word_cost), np.concatenate(word_size)
            tables = []
            for row in range(part.num_rows):
                of = part.slice(row, 1).select(["words", "width", "raw", "packed"]).to_pylist()[0]
                ends = np.append(0, np.cumsum(np.array(of["words"], np.int64)))
                codes = _unpacked(of["packed"], of["width"], of["raw"], ends)
                if len(of["words"]) > 1:
                    cost, size = sums(word_cost[codes], ends), sums(word_size[codes], ends)
                else:  # a text may be long: its words are counted first
                    times = np.bincount(codes, minlength=len(word_size))
                    cost, size = (times @ word_cost)[None], np.array([times @ word_size])
                names, score, entropy, accepted = plain.judge(cost, size)
                keys = part.column("keys").slice(row, 1).combine_chunks().flatten()
                tables.append(pa.table({"key": keys, "lang_pred": pa.array(names, pa.string()), "score": score, "cross_entropy": entropy, "accepted": accepted}))
            return pa.concat_tables(tables)

        grams = parts.where(F.col("grams").isNotNull()).select(F.col("slice").alias("of"), F.explode("grams").alias("gram"))
        cost = self.priced(grams).select("gram", F.col("cost").cast("array<float>").alias("cost"))
        costs = grams.join(cost.hint("merge"), "gram").select("of", "gram", "cost")
        return parts.drop("grams").groupBy("slice").cogroup(costs.groupBy("of")).applyInArrow(meet, out)


def train(docs: DataFrame) -> Model:
    """A model of every language in ``docs``, from the rows that are not held out and have a text and a language.

    Every such row counts and every n-gram is kept. Only the languages' names, the number of
    symbols and a few figures per language and order reach the driver. Without any such row the
    model knows no language and calls every text unknown.
    """
    grams = written(counts(docs.where(~held_out() & F.col("doc_id").isNotNull())), "grams")
    langs = sorted(r["lang"] for r in grams.select("lang").distinct().collect())
    if not langs:
        return Model(langs, 1)
    missing = F.when(F.col("kind") == 0, 0.0).otherwise(1.0)
    of_lang = [F.max(F.when(F.col("lang") == x, F.col("value"))).alias(f"v{i}") for i, x in enumerate(langs)]
    values = F.array(*[F.coalesce(f"v{i}", missing) for i in range(len(langs))]).alias("value")
    counted, tables = grams.withColumnRenamed("n", "c"), []
    for order in range(ORDER, 0, -1):
        found = probabilities(counted, order).groupBy("kind", "gram").agg(*of_lang).select("kind", "gram", values)
        tables.insert(0, written(found.sortWithinPartitions("kind"), f"model-{order}"))
        if order > 1:
            shorter = counted.select("lang", F.substring("gram", 2, order - 1).alias("gram"))
            counted = written(shorter.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("c")), f"counts-{order - 1}")
    model = Model(langs, tables[0].where("kind = 0").count() + 1, tables=tables)
    own = F.get("cost", (F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1).cast("int"))
    each = grams.join(model.priced(grams).hint("merge"), "gram").select("lang", F.col("n").cast("double").alias("n"), own.alias("cost"))
    sums_of = (F.sum(x).alias(name) for name, x in (("n", F.col("n")), ("cost", F.expr("n * cost")), ("square", F.expr("n * cost * cost"))))
    totals = {r["lang"]: r for r in each.groupBy("lang").agg(*sums_of).collect()}
    n, cost, square = (np.array([totals[x][c] for x in langs]) for c in ("n", "cost", "square"))
    model.mean = cost / n
    model.deviation = np.sqrt(np.maximum(0, square / n - model.mean**2))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, accepted: one row per row of ``docs``.

    A null text, or one without a letter, is ``und`` with score 0 and not accepted. The score is the
    best language's share when costs are turned into probabilities, one observation per word.
    """
    texts = texts_of(docs)
    if model.langs:
        found = model.judged(texts, "doc_id").withColumnRenamed("key", "doc_id")
    else:
        found = texts.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), F.lit(False).alias("accepted"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text the model accepts. A null text is never accepted.

    The verdict depends on the text alone, so the digests of the rejected texts are written and kept
    away from ``docs`` by an anti-join; where they are few, Spark sends them by their written size.
    """
    if not model.langs:
        return docs.where(F.lit(False))
    some = bounded(docs).where(F.col("text").isNotNull())
    digests = model.judged(some.select(F.md5("text").alias("digest"), "text"), "digest")
    rejected = written(digests.where(~F.col("accepted")).select(F.col("key").alias("_rejected")).distinct(), "rejected")
    return some.join(rejected, F.md5(some["text"]) == rejected["_rejected"], "left_anti")
