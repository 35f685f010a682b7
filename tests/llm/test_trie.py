import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidecast.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def rebuilt(rows):
    """Each conversation's rebuilt (digest, words), from plain lists."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            words = len([w for w in text.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w])
            own[conv].append(((turn is not None, turn or 0), digest(role, text), words))
    own = {c: [(d, w) for _, d, w in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(x for x, _ in turns[:d])].append(c)
    words = {tuple(x for x, _ in t[:d]): t[d - 1][1] if d else 0 for t in convs.values() for d in range(len(t) + 1)}
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, inside in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(inside) - 1) * words[path]
    out = []
    for path, inside in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in inside if len(convs[c]) == len(path)))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(inside), len(path), parent, len(inside), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def conversations(seed, count, longest, kinds=3):
    r = random.Random(seed)
    rows = []
    for conv in range(-25, count):
        if r.random() < 0.15:
            continue
        length = r.randint(1, longest)
        for turn in range(length):
            text = r.choice([f"text {r.randint(1, kinds)}", "a  b\tc\vd", None, ""]) if turn else f"opening {r.randint(1, 2)}"
            rows.append((conv, r.choice([turn, turn, turn, None]) if turn > 4 else turn, r.choice(["user", None]), text))
    twin = [x for x in rows if x[0] == 3]
    rows += [(1000 + i * 20, t, role, text) for i in range(6) for _, t, role, text in twin]  # whole copies
    return [*rows, (None, 1, "user", "nobody"), (7, 2, "user", "tie"), (7, 2, "user", "tie")]


@pytest.mark.parametrize("window", [3, 128])
def test_the_trie_is_that_of_brute_force(spark, window, monkeypatch):
    rows = conversations(5, 60, 9)
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "n", "depth", "conv", "words", "part", "digest", "head")})
    expected = brute(rebuilt(rows))
    monkeypatch.setattr(trie, "CHAIN", 3)
    assert rows_of(trie.trie(*trie.rebuilt(table.repartition(5)), window=window)) == expected


def test_runs_of_few_rows_and_groups_over_many_runs(spark, monkeypatch):
    """Copies, prefixes and chains that reach over many tasks."""
    rows = [(i, t, "user", f"t{t}") for i in range(0, 2000, 20) for t in range(1 + i % 7)]
    rows += [(i, t, "user", f"t{t}") for i in (2000, 2020, 2040) for t in range(9)]
    monkeypatch.setattr(trie, "ROWS", 3)
    monkeypatch.setattr(trie, "TURNS", 5)
    for window in (3, 128):
        assert rows_of(trie.trie(*trie.rebuilt(spark.createDataFrame(rows, SCHEMA)), window=window)) == brute(rebuilt(rows))


def test_a_conversation_of_a_third_of_all_rows(spark, monkeypatch):
    rows = [(1, t, "user", f"turn {t}") for t in range(700)] + [(21, t, "user", f"turn {t}") for t in range(650)] + conversations(9, 50, 6)
    monkeypatch.setattr(trie, "TURNS", 100)
    assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rebuilt(rows))


def test_empty_one_and_turnless(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    for rows in ([(5, None, None, None)], [(c, 1, "user", "x y") for c in range(40)]):
        assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rebuilt(rows))
    assert any(not turns for turns in rebuilt([(c, 1, "user", "x y") for c in range(21, 40)]).values())
    rows = [(c, 1, "user", "x y") for c in range(21, 40)]
    assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rebuilt(rows))
