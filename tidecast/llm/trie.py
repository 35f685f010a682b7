"""The prefix trie of conversations, from sorted neighbours and their common prefixes.

Conversations are sorted by the digests of their turns. A task takes a run of them, finds how many
turns each shares with the one before, and joins neighbours by union-find, deepest prefix first:
every merge of two components is a branching node of the run's forest, and the turns between two
branchings are nodes with one child. Everything a node reports is a sum over its conversations:

* leaves: those whose successor does not continue them;
* children: those that start a path just below the node;
* saved words: what each shares with its predecessor, less what lies above the node.

So forests of different runs need no second pass over conversations. A forest's inner nodes are
final. The nodes of its first and last conversation are contracted to a row each, named by the
digest of their path; rows of one name are added up over all runs, after two small corrections that
follow from what a run's first conversation shares with the last one of the run before.

A conversation is looked at in windows of ``WINDOW`` turns, so that no row grows with its length.
Those that share a whole window with another go to the next level, below one root for each group;
the roots' sums are added to the nodes above them, deepest level first. Conversations alone in their
group are a chain from there on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.llm.common import bounded, column, cores, numbers, offsets, to_batch, written
from tidecast.llm.packing import ddl
from tidecast.operators.joins import lookup_join

#: Turns of a conversation looked at together.
WINDOW = 128
#: Conversations, and bytes of their paths, that a task sorts into one forest.
ROWS, BYTES = 100_000, 32 << 20
#: Turns that a task numbers, and depths of a chain that are made from one row.
TURNS, CHAIN = 2_000_000, 10_000
#: A digest's bytes: a path holds its group's digest and one for every turn.
DIGEST = 16
ROOT = bytes(DIGEST)
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: What parts words.
WORDS = r"[^\x20\x09-\x0D]+"

NODE, EDGE, FULL = 0, 1, 2
_FOREST = pa.schema(
    [
        ("what", pa.int32()), ("part", pa.int64()), ("id", pa.binary()), ("parent_id", pa.binary()), ("depth", pa.int64()), ("least", pa.int64()),
        ("parent", pa.int64()), ("n", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("shared", pa.int64()), ("above", pa.int64()),
        ("ends", pa.string()), ("piece", pa.string()), ("path", pa.binary()), ("last", pa.binary()), ("words", pa.list_(pa.int64())),
    ]
)
_ADDED = pa.schema([("id", pa.binary()), ("children", pa.int64()), ("leaves", pa.int64()), ("shared", pa.int64())])
_NUMBERED = pa.schema([("part", pa.int64()), ("conv", pa.int64()), ("head", pa.bool_()), ("rank", pa.int64()), ("heads", pa.int64()), ("first", pa.bool_()), ("digest", pa.string()), ("words", pa.int64())])
_SHA = pa.schema([("id", pa.binary()), ("ends", pa.string())])


def named(path: bytes, depth: int) -> bytes:
    """The name of the node that ends ``depth`` digests of ``path``; a group's root bears the group's."""
    return path[:DIGEST] if depth == 1 else hashlib.md5(path[: DIGEST * depth]).digest()


class Forest:
    """Sorted paths joined by union-find over the prefixes that neighbours share, in descending depth."""

    def __init__(self, paths: np.ndarray, bounds: np.ndarray, conv: np.ndarray):
        """``paths``: digests as rows of two numbers, laid end to end, each path between two ``bounds``."""
        self.bounds, self.length = bounds, np.diff(bounds)
        self.lcp = self._common(paths)
        m = len(conv)
        depth, low, high = self.length.tolist(), list(range(m)), list(range(m))
        least, parent, children, ended = conv.tolist(), [-1] * m, [0] * m, [1] * m
        kept, label, top = [True] * m, list(range(m)), list(range(m))

        def find(i: int) -> int:
            while label[i] != i:
                label[i] = i = label[label[i]]
            return i

        lcp = self.lcp.tolist()
        for i in np.lexsort([np.arange(m), -self.lcp]).tolist():
            shared = lcp[i]
            if not shared:
                break
            x, y = find(i - 1), find(i)
            a, b = top[x], top[y]
            if depth[a] == shared:
                v = a
            else:
                v = len(depth)
                for held, value in zip((depth, low, high, least, parent, children, ended, kept), (shared, low[a], high[a], least[a], -1, 1, 0, True), strict=True):
                    held.append(value)
                parent[a] = v
            if depth[b] == shared:  # a copy: equal paths are one node
                kept[b], ended[v] = False, ended[v] + 1
            else:
                parent[b], children[v] = v, children[v] + 1
            high[v], least[v] = high[b], min(least[v], least[b])
            label[y] = x
            top[x] = v
        keep = np.flatnonzero(np.array(kept, bool)) if m else np.zeros(0, np.int64)
        place = np.zeros(len(kept) + 1, np.int64)
        place[keep] = np.arange(len(keep))
        self.depth, self.low, self.high, self.least, self.children, self.ended = (np.array(x, np.int64)[keep] for x in (depth, low, high, least, children, ended))
        up = np.array(parent, np.int64)[keep]
        self.parent = np.where(up < 0, -1, place[up])

    def _common(self, paths: np.ndarray) -> np.ndarray:
        """Digests that each path shares with the one before; 0 for the first."""
        begin, length = self.bounds[:-1], self.length
        out, alive, depth = np.zeros(len(length), np.int64), np.arange(1, len(length)), 0
        while len(alive):
            alive = alive[(length[alive - 1] > depth) & (length[alive] > depth)]
            alive = alive[(paths[begin[alive - 1] + depth] == paths[begin[alive] + depth]).all(axis=1)]
            depth += 1
            out[alive] = depth
        return out


def forest(table: pa.Table, part: int, start: int, window: int) -> Iterator[pa.RecordBatch]:
    """The nodes of sorted conversations (path, conv, n, base, words), the run's edges, and who fills the window."""
    conv, n, base = (table.column(c).to_numpy() for c in ("conv", "n", "base"))
    paths, words = table.column("path").combine_chunks(), table.column("words").combine_chunks()
    whole = [p.as_py() for p in paths]
    data = np.frombuffer(b"".join(whole), np.uint64).reshape(-1, 2)
    bounds = np.concatenate([[0], np.cumsum([len(p) // DIGEST for p in whole])]).astype(np.int64)
    made = Forest(data, bounds, conv)
    m, length, lcp = len(conv), made.length, made.lcp
    # Words of the first j turns of each window, j from 0.
    each = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    begin = offsets(words)
    total = np.concatenate([[0], np.cumsum(each)])

    def before(i: np.ndarray, turns: np.ndarray) -> np.ndarray:
        return base[i] + total[begin[i] + turns] - total[begin[i]]

    full = length == window + 1
    at = np.arange(m)
    shared = np.where((lcp > 0) & ~(full & (lcp == length)), before(at, np.maximum(lcp - 1, 0)), 0)
    after = np.append(lcp[1:], 0)
    leaf = ((after < length) & ~full).astype(np.int64)
    sum_shared, sum_leaf, sum_full = (np.concatenate([[0], np.cumsum(x)]) for x in (shared, leaf, full.astype(np.int64)))
    # A row for every depth between a node and the one above it.
    upper = np.where(made.parent < 0, 0, made.depth[made.parent]) if len(made.depth) else np.zeros(0, np.int64)
    count = made.depth - upper
    node = np.repeat(np.arange(len(count)), count)
    depth = np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count) + upper[node] + 1
    low, high = made.low[node], made.high[node]
    spine = (made.low == 0) | (made.high == m - 1)
    open_ = spine[node] | (sum_full[high + 1] > sum_full[low]) | (depth == 1)
    lowest = depth == made.depth[node]
    highest = depth == upper[node] + 1
    above = made.parent[node]
    by_name = (depth > 1) & np.where(highest, spine[above], spine[node])
    names: dict[tuple[int, int], bytes] = {}

    def name(i: int, d: int) -> bytes:
        if (i, d) not in names:
            names[i, d] = named(whole[i], d)
        return names[i, d]

    first_above = np.where(highest, made.low[above], low)
    listed = list(zip(low.tolist(), first_above.tolist(), depth.tolist(), open_.tolist(), by_name.tolist(), strict=True))
    parent = np.where(highest, made.least[above], made.least[node])
    parent = pa.array(parent, pa.int64(), mask=by_name | (depth == 1))
    ends, pieces = [None if s else NO_ENDS for s in spine[node].tolist()], [None] * len(node)
    for row in np.flatnonzero(lowest & (made.ended[node] > 0)).tolist():
        run = slice(low[row], low[row] + made.ended[node[row]])
        ids = conv[run][n[run] == start + depth[row] - 1]
        if len(ids):
            text = ",".join(map(str, ids.tolist()))
            if spine[node[row]]:
                pieces[row] = text
            else:
                ends[row] = hashlib.sha256(text.encode()).hexdigest()
    nodes = {
        "what": np.full(len(node), NODE), "part": np.full(len(node), part), "depth": start + depth - 1, "least": made.least[node], "parent": parent,
        "id": [name(i, d) if o else None for i, _, d, o, _ in listed], "parent_id": [name(j, d - 1) if b else None for _, j, d, _, b in listed],
        "n": high - low + 1, "children": np.where(lowest, made.children[node], 1), "leaves": sum_leaf[high + 1] - sum_leaf[low],
        "shared": sum_shared[high + 1] - sum_shared[low + 1], "above": np.where(depth > 1, before(low, np.maximum(depth - 2, 0)), 0), "ends": ends, "piece": pieces,
    }
    yield _rows(nodes, len(node))
    if m:
        yield _rows({"what": [EDGE], "part": [part], "path": [whole[0]], "last": [whole[-1]], "words": [words[0].as_py()], "above": [base[0]]}, 1)
    filled = np.flatnonzero(full)
    if len(filled):
        new = np.append(True, (np.diff(filled) > 1) | (lcp[filled[1:]] < window + 1)).tolist()
        found = filled.tolist()
        shown = [whole[i] if f else None for i, f in zip(found, new, strict=True)]
        firsts = np.maximum.accumulate(np.where(new, filled, 0)).tolist()
        ids = [name(i, window + 1) for i in firsts]
        yield _rows({"what": [FULL] * len(found), "part": [part] * len(found), "id": ids, "least": conv[filled], "n": n[filled], "above": before(filled, np.full(len(filled), window)), "path": shown}, len(found))


def _rows(columns: dict, count: int) -> pa.RecordBatch:
    return to_batch(_FOREST, **{f.name: columns.get(f.name, pa.nulls(count, f.type)) for f in _FOREST})


def corrected(edges: DataFrame, window: int) -> DataFrame:
    """What the nodes of runs counted that another run holds, by name: two paths a run reach this step, whatever a run holds."""
    beside = edges.select("part", "path", "words", "above", F.lag("last").over(W.orderBy("part")).alias("previous"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _ADDED}
            for row in batch.to_pylist():
                path, previous = row["path"], row["previous"]
                if previous is None:
                    continue
                most = min(len(path), len(previous)) // DIGEST
                common = next((d for d in range(most) if path[d * DIGEST : (d + 1) * DIGEST] != previous[d * DIGEST : (d + 1) * DIGEST]), most)
                if not common:
                    continue
                size = len(previous) // DIGEST
                same_window = common == window + 1
                shared = 0 if same_window else row["above"] + sum(row["words"][: common - 1])
                for d in range(1, common + 1):
                    out["id"].append(named(path, d))
                    out["children"].append(-1 if d < common else 0)
                    out["leaves"].append(-1 if common == size and not same_window else 0)
                    out["shared"].append(shared)
            yield to_batch(_ADDED, **out)

    return beside.mapInArrow(work, ddl(_ADDED))


def raised(roots: DataFrame) -> DataFrame:
    """(path, children, leaves, shared) of groups' roots, added to every node of their paths: the lowest gets all, the others no children."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size = len(row["path"]) // DIGEST
                ids = [named(row["path"], d) for d in range(1, size + 1)]
                yield to_batch(_ADDED, id=ids, children=[0] * (size - 1) + [row["children"]], leaves=[row["leaves"]] * size, shared=[row["shared"]] * size)

    return roots.select("path", "children", "leaves", "shared").mapInArrow(work, ddl(_ADDED))


def digests(pieces: DataFrame) -> DataFrame:
    """id, ends: the digest of each node's joined pieces (id, part, piece), read in order and never held together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, hashlib.sha256()
        for batch in batches:
            done: dict[str, list] = {"id": [], "ends": []}
            for name, piece in zip(column(batch, "id").to_pylist(), column(batch, "piece").to_pylist(), strict=True):
                if name != current:
                    if current is not None:
                        done["id"].append(current)
                        done["ends"].append(state.hexdigest())
                    current, state = name, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            yield to_batch(_SHA, **done)
        if current is not None:
            yield to_batch(_SHA, id=[current], ends=[state.hexdigest()])

    # One digest is made in order by its definition: a node's pieces meet in one task, as a stream.
    return pieces.repartition("id").sortWithinPartitions("id", "part").mapInArrow(work, ddl(_SHA))


def numbered(events: DataFrame, skipped: Column) -> DataFrame:
    """conv, depth, digest, words: turns in order, a conversation's heads before its own.

    ``events``: conv, head, turn, digest, words, unique. Own turns up to number ``skipped`` are left
    out. Turns are dealt by range, so one conversation may span many tasks; what a task's first
    conversation has in earlier tasks is added afterwards, a row a task.
    """
    spark = events.sparkSession
    parts = max(cores(spark), -(-events.count() // TURNS))
    order = [F.col("conv"), F.desc("head"), F.asc_nulls_first("turn"), F.col("digest"), F.col("unique")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, current, heads, own = TaskContext.get().partitionId(), None, None, 0, 0
        for batch in batches:
            conv, head = numbers(batch, "conv"), numbers(batch, "head").astype(bool)
            if not len(conv):
                continue
            first = int(conv[0]) if first is None else first
            new = np.append(conv[0] != current, conv[1:] != conv[:-1])
            starts = np.flatnonzero(new)
            group = np.cumsum(new)
            both = []
            for flag, carried in ((head, heads), (~head, own)):
                run = np.cumsum(flag)
                # Before the batch's first start the conversation of the batch before goes on.
                base = np.append(-carried, run[starts] - flag[starts])
                both.append(run - base[group])
            current, heads, own = int(conv[-1]), int(both[0][-1]), int(both[1][-1])
            yield to_batch(
                _NUMBERED, part=np.full(len(conv), part), conv=conv, head=head, rank=np.where(head, both[0], both[1]), heads=both[0], first=conv == first,
                digest=column(batch, "digest"), words=numbers(batch, "words"),
            )

    made = written(events.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(work, ddl(_NUMBERED)), "numbered")
    # At most one conversation a task comes from the task before: a row a task, so it may be sent to all.
    opening = made.where("first").select("conv").distinct()
    sizes = made.join(F.broadcast(opening), "conv").groupBy("part", "conv").agg(F.sum((~F.col("head")).cast("long")).alias("o"), F.sum(F.col("head").cast("long")).alias("h"))
    earlier = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = sizes.select("part", "conv", F.sum("o").over(earlier).alias("own_before"), F.sum("h").over(earlier).alias("heads_before")).where("own_before IS NOT NULL")
    zero = F.lit(0)
    whole = made.join(F.broadcast(carried), ["part", "conv"], "left")
    number = F.col("rank") + F.when(F.col("head"), F.coalesce("heads_before", zero)).otherwise(F.coalesce("own_before", zero))
    whole = whole.select("conv", "head", "digest", "words", number.alias("number"), (F.col("heads") + F.coalesce("heads_before", zero)).alias("heads"))
    depth = F.when(F.col("head"), F.col("number")).otherwise(F.col("number") - skipped + F.col("heads"))
    return whole.where(F.col("head") | (F.col("number") > skipped)).select("conv", depth.alias("depth"), "digest", "words")


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, digest, words) and conversations (conv, n) after each took over the beginning of another.

    Conversation c begins with the first h turns of conversation c - c % ``every`` and goes on with
    its own after its first h, where h is the unsigned crc32 of its decimal id modulo ``most``. A
    null role or text is empty; turns are in order of ``turn``, null first, those with one number by
    digest. Rows without a conversation are left out.
    """
    h = F.crc32(F.col("conv").cast("string")) % most
    base = F.col("conv") - F.col("conv") % every
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    slim = bounded(conversations).where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words")
    )
    slim = written(slim.withColumn("unique", F.monotonically_increasing_id()), "turns")
    sizes = written(slim.groupBy("conv").agg(F.count(F.lit(1)).alias("own")), "sizes")
    # Spark keeps the first few rows of a conversation within each task, before any shuffle.
    number = F.row_number().over(W.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "digest", "unique"))
    firsts = slim.where(F.col("conv") % every == 0).withColumn("number", number).where(F.col("number") < most)
    firsts = firsts.select(F.col("conv").alias("base"), F.col("number").cast("long").alias("number"), "digest", "words")
    heads = sizes.select("conv", base.alias("base"), h.alias("h")).join(firsts, "base").where(F.col("number") <= F.col("h"))
    heads = heads.select("conv", F.lit(True).alias("head"), F.col("number").alias("turn"), "digest", "words", F.lit(0).cast("long").alias("unique"))
    turns = written(numbered(slim.select("conv", F.lit(False).alias("head"), "turn", "digest", "words", "unique").unionByName(heads), h), "rebuilt")
    taken = sizes.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    convs = sizes.withColumns({"base": base, "h": h}).join(taken, "base", "left")
    length = F.least(F.col("h"), F.coalesce("there", F.lit(0))) + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return turns, convs.select("conv", length.alias("n"))


def level(turns: DataFrame, members: DataFrame, start: int, window: int) -> DataFrame:
    """The forests of ``members`` (conv, n, gid, base) over their turns ``start`` + 1 to ``start`` + ``window``."""
    here = turns.where((F.col("depth") > start) & (F.col("depth") <= start + window))
    if start:
        here = here.join(members.select("conv"), "conv", "left_semi")
    listed = here.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "words"))).alias("x"))
    none = F.array().cast("array<bigint>")
    path = F.concat("gid", F.coalesce(F.unhex(F.array_join("x.digest", "")), F.lit(b"")))
    rows = members.join(listed, "conv", "left").select(path.alias("path"), "conv", "n", "base", F.coalesce(F.col("x.words"), none).alias("words"))
    rows = written(rows, "paths")
    count, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()
    parts = max(cores(turns.sparkSession), -(-count // ROWS), -(-size // BYTES))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from forest(pa.Table.from_batches(held), TaskContext.get().partitionId(), start, window)

    return written(rows.repartitionByRange(parts, "path", "conv").sortWithinPartitions("path", "conv").mapInArrow(work, ddl(_FOREST)), "forest")


def trie(turns: DataFrame, convs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every node of the trie of ``turns`` (conv, depth from 1 without gaps, digest, words) of ``convs`` (conv, n).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Digests are 32 hexadecimal letters. No conversation gives no node.
    """
    convs = written(convs, "conversations")
    members = convs.select("conv", "n", F.lit(ROOT).alias("gid"), F.lit(0).cast("long").alias("base"))
    levels, start = [], 0
    while True:
        made = level(turns, members, start, window)
        filled = made.where(F.col("what") == FULL)
        groups = written(filled.groupBy("id").agg(F.count(F.lit(1)).alias("size"), F.max("path").alias("path"), F.min("least").alias("conv"), F.max("n").alias("n")), "groups")
        alone = groups.where("size = 1")
        levels.append((start, made, groups))
        # By conversation, not by group, which may hold a third of them.
        members = filled.select(F.col("least").alias("conv"), "n", F.col("id").alias("gid"), F.col("above").alias("base")).join(alone.select("conv"), "conv", "left_anti")
        start += window
        if groups.where("size > 1").isEmpty():
            break
        members = written(members, "members")
    parts, roots = [], None
    for start, made, groups in reversed(levels):
        nodes = made.where(F.col("what") == NODE)
        zero = F.lit(0).cast("long")
        below = groups.where("size = 1").select("path", F.when(F.col("n") > start + window, 1).otherwise(0).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"), zero.alias("shared"))
        if roots is not None:
            below = below.unionByName(groups.where("size > 1").join(roots.select("id", "children", "leaves", "shared"), "id").select("path", "children", "leaves", "shared"))
        added = raised(below).unionByName(corrected(made.where(F.col("what") == EDGE), window))
        opened = nodes.where(F.col("id").isNotNull()).select(*[f.name for f in _ADDED], "depth", "least", "parent", "parent_id", "n", "above", F.col("ends"))
        sums = [F.sum(c).alias(c) for c in ("children", "leaves", "shared", "n")]
        least = [F.min("least").alias("least"), *[F.max(c).alias(c) for c in ("depth", "parent", "parent_id", "above", "ends")]]
        merged = written(opened.unionByName(added, allowMissingColumns=True).groupBy("id").agg(*sums, *least), "merged")
        ended = digests(nodes.where(F.col("piece").isNotNull()).select("id", "part", "piece")).withColumnRenamed("ends", "joined")
        merged_all = merged.join(ended, "id", "left").withColumn("ends", F.coalesce("joined", "ends", F.lit(NO_ENDS))).drop("joined")
        if start:
            roots = merged.where(F.col("depth") == start)
        final = nodes.where(F.col("id").isNull()).select(*merged_all.columns).unionByName(merged_all)
        known = final.where(F.col("parent_id").isNull())
        asked = final.where(F.col("parent_id").isNotNull()).drop("parent")
        spines = merged.select(F.col("id").alias("parent_id"), F.col("least").alias("parent"))
        met = lookup_join(asked, spines, ["parent_id"], hot=[(bytearray(ROOT),)] if not start else ())
        parts.append(known.unionByName(met.select(known.columns)).where(F.col("depth") > start if start else F.lit(True)))
        # Beyond its window a conversation alone in its group is a chain.
        chain = groups.where(f"size = 1 AND n > {start + window}").select("conv", "n", F.explode(F.expr(f"sequence({start + window + 1}L, n, {CHAIN}L)")).alias("low"))
        if not chain.isEmpty():
            depth = F.explode(F.sequence("low", F.least(F.col("n"), F.col("low") + CHAIN - 1))).alias("depth")
            last = F.col("depth") == F.col("n")
            parts.append(
                chain.repartition("conv", "low").select("conv", "n", depth).select(
                    F.lit(None).cast("binary").alias("id"), F.when(last, 0).otherwise(1).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"),
                    zero.alias("shared"), F.lit(1).cast("long").alias("n"), F.col("conv").alias("least"), "depth", F.col("conv").alias("parent"),
                    F.lit(None).cast("binary").alias("parent_id"), zero.alias("above"), F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(NO_ENDS).alias("ends"),
                )
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    saved = F.col("shared") - (F.col("n") - 1) * F.col("above")
    return out.select(
        F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of (conv_id, turn, role, text); see ``rebuilt`` and ``trie``. Other columns are left out."""
    return trie(*rebuilt(conversations))
