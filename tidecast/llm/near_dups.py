"""Near-duplicate documents by MinHash with tensored bands, every link confirmed on full sets.

A table's key joins one sketch of a left collection with one of a right collection, so ``M``
sketches a side give ``M * M`` tables: ``2 * M * R`` minhashes do the work of ``M * M * 2 * R``.

Documents with equal sets are one class, found by a digest and represented by the smallest doc_id.
Classes that share a key are candidates, compared in two rounds so that a large group does not
turn into all its pairs. First each class meets one other: of the smallest classes of its keys, the
one it shares most keys with. Then the two classes of every key that holds no third are compared,
where they are still apart: at most a pair a key. Last, where a key still holds several components, its classes are gathered in bundles (classes connected by such
keys), a bundle is dealt into blocks, and a task takes two blocks: it compares classes of different
components, the likeliest first, and joins components as it finds links, so that what lies in one
component by then is not compared. Components are those of all candidate pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import coded, column, slices, texts_of, to_batch, written
from tidecast.llm.packing import ddl

#: Text handled at once: every shingle becomes a few 64-bit numbers, about twenty times the text's bytes.
SLICE = 1 << 20
#: Words of a shingle, and the similarity that links, in percent.
WORDS, PERCENT = 5, 85
#: Minhashes of a sketch and sketches of a collection. A pair at 0.85 shares a sketch of three
#: with chance 0.61; it misses all eight of a side, and with them every table, in 1 of 1,000 cases.
R, M = 3, 8

_SKETCHES = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))]
)
_SETS = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])
#: Classes of a block in the second round, and the share of equal minhashes below which a pair is
#: not compared there: at similarity 0.85 all 48 fall so low in one of a million cases.
BLOCK, HOPE = 512, 0.6
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def seeds() -> tuple[np.ndarray, np.ndarray]:
    n = 2 * M * R
    made = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _GOLD)
    return made[:n], made[n:] | np.uint64(1)


def shingle_sets(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles of ``size`` words as 64-bit hashes in ascending order, laid end to end, with bounds.

    Words are runs without ASCII white space, A-Z lower-cased. Fewer words than a shingle has are
    one shingle; no word, none.
    """
    dictionary, codes, rows = coded(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
    words = dictionary.to_pylist()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    empty = np.array([not w for w in words], bool)
    if empty.any():  # white space at a text's ends gives empty words
        real = ~empty[codes]
        rows = np.concatenate([np.zeros(1, np.int64), np.cumsum(real)])[rows]
        codes = codes[real]
    h = hashes[codes] if len(words) else np.zeros(0, np.uint64)
    whole = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for i in range(size):
        whole = whole * _GOLD + h[i : len(h) - size + 1 + i] if len(whole) else whole
    whole = mix(whole)
    out, sizes = [], np.zeros(len(texts), np.int64)
    for i, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
        if b - a >= size:
            found = np.unique(whole[a : b - size + 1])
        elif b > a:
            found = np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes())], np.uint64)
        else:
            continue
        out.append(found)
        sizes[i] = len(found)
    flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return flat, np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def minhashes(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All ``2 * M * R`` minhashes of each set, a row for each hash. Zeros for an empty set."""
    some = np.flatnonzero(np.diff(bounds))
    out = np.zeros((2 * M * R, len(bounds) - 1), np.uint32)
    flip, times = seeds()
    if len(some):
        for k in range(2 * M * R):
            out[k, some] = np.minimum.reduceat(((flat ^ flip[k]) * times[k]) >> np.uint64(32), bounds[:-1][some])
    return out


def halves(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The left and right collection of each set: ``M`` sketches of ``R`` minhashes. Zeros for an empty set."""
    least, some = minhashes(flat, bounds).astype(np.uint64), np.diff(bounds) > 0
    out = np.zeros((2 * M, len(bounds) - 1), np.uint64)
    for k in range(2 * M * R):
        out[k // R] = np.where(some, mix(out[k // R] * _GOLD + least[k]), 0)
    out = out.view(np.int64).T
    return out[:, :M], out[:, M:]


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(np.ascontiguousarray(values).ravel()))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the set's digest (d1, d2) and the two collections, for every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            flat, bounds = shingle_sets(column(batch, "text"))
            left, right = halves(flat, bounds)
            digest = [xxhash.xxh3_128_digest(flat[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            digest = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            yield to_batch(
                _SKETCHES, doc_id=column(batch, "doc_id"), n_shingles=np.diff(bounds), d1=digest[:, 0], d2=digest[:, 1], left=_lists(left), right=_lists(right)
            )

    return texts_of(docs).mapInArrow(work, ddl(_SKETCHES))


def sets(docs: DataFrame) -> DataFrame:
    """doc_id and its shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            flat, bounds = shingle_sets(column(batch, "text"))
            yield to_batch(_SETS, doc_id=column(batch, "doc_id"), shingles=pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view(np.int64))))

    return texts_of(docs).mapInArrow(work, ddl(_SETS))


def keys(classes: DataFrame) -> DataFrame:
    """key, rep, n: the ``M * M`` tables' keys of every class."""
    tables = F.flatten(
        F.transform("left", lambda a, i: F.transform("right", lambda b, j: F.xxhash64(i, j, a, b)))
    )
    return classes.select(F.explode(tables).alias("key"), "rep", F.col("n_shingles").alias("n"))


def alike(n: str, m: str):
    """Whether sets of these sizes can reach the similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def confirmed(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets reach the similarity."""
    with_v = pairs.join(members.select(F.col("doc_id").alias("v"), F.col("shingles").alias("sv")), "v")
    both = with_v.join(members.select(F.col("doc_id").alias("u"), F.col("shingles").alias("su")), "u")
    common = F.size(F.array_intersect("su", "sv"))
    linked = common * 100 >= (F.size("su") + F.size("sv") - common) * PERCENT
    return both.where(linked).select("u", "v")


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable over ``links`` (u, v), for every node of a link.

    Every round takes the smallest label next to a node, then the label's own label, and is
    written, so that rounds are few and none is computed again.
    """
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        closer = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # The label's label, as it was before this round: still a node of the same component.
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = written(closer.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where(F.col("label") != F.col("old")).isEmpty():
            return labels.withColumnRenamed("label", "component")


def bundles(rest: DataFrame) -> DataFrame:
    """rep, component, bundle: the classes of ``rest`` (key, rep, component), connected by their keys."""
    lead = rest.groupBy("key").agg(F.min("rep").alias("u"))
    connected = components(written(rest.join(lead, "key").select("u", F.col("rep").alias("v")).distinct(), "keys"))
    return rest.select("rep", "component").distinct().join(connected.select(F.col("node").alias("rep"), F.col("component").alias("bundle")), "rep")


def links_between(bundled: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """u, v: components of which two classes of one bundle are linked; enough of them to connect all that are."""
    blocks = bundled.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    dealt = bundled.join(blocks, "bundle").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = dealt.join(members.withColumnRenamed("doc_id", "rep"), "rep")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pairs = dealt.withColumn("other", other).withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})

    def work(key, table):
        table = table.sort_by("rep").combine_chunks()
        component, own = table.column("component").to_numpy(), table.column("own").to_numpy()
        lists = table.column("shingles").combine_chunks()
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sizes, hashes = np.diff(bounds), minhashes(flat, bounds)
        label = {c: c for c in component.tolist()}

        def find(c: int) -> int:
            while label[c] != c:
                label[c] = c = label[label[c]]
            return c

        found: list[tuple[int, int]] = []
        left, right = np.flatnonzero(own == key[1].as_py()), np.flatnonzero(own == key[2].as_py())
        apart, hopes = key[1].as_py() != key[2].as_py(), [np.zeros((0, 3))]
        for i in left.tolist():
            j = right[(component[right] != component[i]) & ((right > i) | apart)]
            j = j[np.minimum(sizes[j], sizes[i]) * 100 >= np.maximum(sizes[j], sizes[i]) * PERCENT]
            same = (hashes[:, j] == hashes[:, [i]]).mean(axis=0)
            j, same = j[same >= HOPE], same[same >= HOPE]
            hopes.append(np.column_stack([-same, np.full(len(j), i), j]))
        hopes = np.concatenate(hopes)
        for i, j in hopes[np.lexsort(hopes.T[::-1]), 1:].astype(np.int64):
            a, b = find(int(component[i])), find(int(component[j]))
            if a == b:
                continue
            common = len(np.intersect1d(flat[bounds[i] : bounds[i + 1]], flat[bounds[j] : bounds[j + 1]], assume_unique=True))
            if common * 100 >= (sizes[i] + sizes[j] - common) * PERCENT:
                label[max(a, b)] = min(a, b)
                found.append((int(component[i]), int(component[j])))
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return pairs.select("bundle", "p", "q", "rep", "own", "component", "shingles").groupBy("bundle", "p", "q").applyInArrow(work, "u long, v long").distinct()


def linked(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """rep, component: for every class that is linked with another."""
    every = keys(classes)
    shared = every.groupBy("key").agg(F.min("rep").alias("lead"), F.min_by("n", "rep").alias("lead_n"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    met = written(every.join(shared, "key"), "met")
    meetings = met.where((F.col("rep") != F.col("lead")) & alike("n", "lead_n")).groupBy(F.col("lead").alias("u"), F.col("rep").alias("v"))
    meetings = written(meetings.agg(F.count(F.lit(1)).alias("keys"), F.bool_or(F.col("size") == 2).alias("two")), "meetings")
    first = meetings.groupBy("v").agg(F.max_by("u", F.struct("keys", -F.col("u"))).alias("u"))
    # Sets of every class that shares a key with one of about its size.
    needed = met.where(F.col("size") > 2).select("rep").unionByName(meetings.select(F.explode(F.array("u", "v")).alias("rep"))).distinct()
    members = written(sets(docs.join(needed.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")).dropDuplicates(["doc_id"]), "sets")
    links = written(confirmed(first, members), "links")
    found = components(links)
    # No later round sees a key of two classes: each such pair that is still apart is compared here.
    twos = meetings.where("two").select("u", "v").join(first.select("v", F.col("u").alias("best")), "v").where(F.col("u") != F.col("best"))
    for side in ("u", "v"):
        twos = twos.join(found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left")
    apart = twos.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")
    more = written(confirmed(apart, members), "links")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    rest = met.where(F.col("size") > 2).join(found.withColumnRenamed("node", "rep"), "rep", "left")
    rest = rest.select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    mixed = rest.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where(F.col("a") != F.col("b")).select("key")
    rest = written(rest.join(mixed, "key"), "mixed")
    if rest.isEmpty():
        return found.withColumnRenamed("node", "rep")
    more = links_between(bundles(rest), members)
    joined = components(written(more, "links"))
    whole = found.withColumnRenamed("node", "rep").unionByName(joined.select(F.col("node").alias("rep"), F.col("node").alias("component"))).groupBy("rep").agg(F.min("component").alias("component"))
    return whole.join(joined.select(F.col("node").alias("component"), F.col("component").alias("joined")), "component", "left").select(
        "rep", F.coalesce("joined", "component").alias("component")
    )


def repeated(rows: DataFrame, column: str) -> bool:
    """Whether a value of ``column`` stands in several rows."""
    return not rows.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1).isEmpty()


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for every row, written so that it stays the same, and the number's name."""
    name = "row"
    while name in docs.columns:
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (doc_id, text).

    A text without words has no shingle and is its own component. A row without a doc_id is
    compared with nothing: its component is null and it is kept. Every row is judged by its own
    text: where a doc_id stands for several sets, rows are compared by a number of their own, and a
    component is named by the smallest doc_id of its rows. Other columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = written(sketches(docs), "sketches")
    real = made.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = real.groupBy("n_shingles", "d1", "d2").agg(F.min(F.struct("doc_id", "left", "right")).alias("least"))
    classes = written(classes.select("n_shingles", "d1", "d2", F.col("least.doc_id").alias("rep"), "least.left", "least.right"), "classes")
    alone = made.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    if repeated(classes, "rep"):
        rows, row = numbered(docs.where(F.col("doc_id").isNotNull()))
        found = deduplicate(rows.select(F.col(row).alias("doc_id"), "text")).where(F.col("n_shingles") > 0)
        found = found.select(F.col("doc_id").alias(row), "n_shingles", F.col("component_id").alias("own")).join(rows.select(row, "doc_id"), row)
        found = written(found, "by-row")
        placed = found.join(found.groupBy("own").agg(F.min("doc_id").alias("component_id")), "own").select("doc_id", "n_shingles", "component_id")
    else:
        found = linked(docs, classes)
        named = classes.select("d1", "d2", "n_shingles", "rep").join(found, "rep", "left").select("n_shingles", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
        placed = real.select("doc_id", "n_shingles", "d1", "d2").join(named, ["n_shingles", "d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    return placed.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their component: of each the row with the smallest doc_id.

    Rows without a doc_id stay. Where a doc_id is repeated, rows are compared by a number of their own, so
    that each text keeps a row of its own; a text without words keeps one row a doc_id.
    """
    nameless, known = docs.where(F.col("doc_id").isNull()), docs.where(F.col("doc_id").isNotNull())
    if not repeated(known, "doc_id"):
        kept = deduplicate(docs).where("kept").select("doc_id").distinct()
        return known.join(kept, "doc_id", "left_semi").select(docs.columns).unionByName(nameless)
    rows, row = numbered(known)
    found = deduplicate(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "n_shingles", "component_id")
    found = found.join(rows.select(row, F.col("doc_id").alias("known_id")), row)
    # A text without words is linked with nothing; its copies under one doc_id are one.
    group = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    kept = found.groupBy(group.alias("own"), F.when(group.isNull(), F.col("known_id")).alias("id")).agg(F.min_by(row, F.struct("known_id", row)).alias(row))
    return rows.join(kept.select(row), row, "left_semi").select(docs.columns).unionByName(nameless)
