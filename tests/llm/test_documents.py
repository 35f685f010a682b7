import random
import re
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from helpers import CLASHING, awkward, awkward_rows, empty, sentences, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidecast.llm import langid, licenses, near_dups, pieces, quality

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# Near duplicates


def shingles(text):
    found = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]+", lambda m: m.group().lower(), (text or "").encode()))
    if len(found) < 5:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def brute_components(rows):
    """doc_id -> smallest reachable doc_id."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {k: new if v == old else v for k, v in label.items()}
    return label, sets


def planted(seed, n=250):
    """Copies, near copies in chains, texts that share long passages, and texts of their own."""
    r = random.Random(seed)
    rows, passage = [], words(40, 99)
    for g in range(n // 10):
        base = words(r.randint(20, 300), 1000 + g).split()
        for _ in range(r.randint(1, 6)):
            rows.append(" ".join(base))
            base = list(base)
            for _ in range(r.randint(0, 2)):
                base[r.randrange(len(base))] = words(1, r.randrange(10**6))
    rows += [passage + " " + words(r.randint(2, 25), 5000 + i) for i in range(40)]
    rows += [words(3, i) for i in range(5)] * 2
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, seed):
    rows = planted(seed)
    got = near_dups.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    label, sets = brute_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), c, c == i) for i, c in label.items()}


def test_a_large_group_of_near_copies(spark):
    """Many texts that share tables but not all links: the second round finds what the first leaves."""
    r = random.Random(4)
    base = words(60, 7).split()
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(r.randint(0, 2)):
            text[r.randrange(60)] = f"w{i}"
        rows.append((i, " ".join(text)))
    got = near_dups.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    label, _ = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == label


def test_chains_whose_links_share_no_key(spark):
    """C is linked with A and with B, A and B are not: where no key holds all three, both links count."""
    rows = []
    for i in range(300):
        text = [f"{w}{i}" for w in words(200, i).split()]
        first, second = list(text), list(text)
        first[40:51] = [f"a{i}x{k}" for k in range(11)]
        second[140:151] = [f"b{i}x{k}" for k in range(11)]
        rows += [(3 * i + k, " ".join(t)) for k, t in enumerate((first, second, text))]
    a, b, c = (shingles(t) for _, t in rows[:3])
    share = lambda x, y: len(x & y) / len(x | y)
    assert 0.85 <= share(a, c) < 0.87 and 0.85 <= share(b, c) < 0.87 and share(a, b) < 0.8
    got = near_dups.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 3 for i, _ in rows}


def test_near_duplicates_of_awkward_rows(spark):
    got = [tuple(r) for r in near_dups.deduplicate(awkward(spark)).collect()]
    by = {}
    for i, n, c, kept in got:
        by.setdefault(i, []).append((n, c, kept))
    assert len(got) == len(awkward_rows())
    assert by[1][0][1:] == (1, True) and by[2][0][1:] == (1, False) and by[3][0][1:] == (1, False)
    assert by[4] == by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)] and by[6] == [(0, 6, True)]
    assert by[7] == [(1, 7, True)] * 2 and by[None][0][1:] == (None, True) and by[9] == [(1, 9, True)]
    assert near_dups.deduplicate(empty(spark)).count() == 0


def test_one_of_each_keeps_columns(spark):
    docs = awkward(spark)
    kept = near_dups.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "4", "5", "6", "7", "None", "8", "9", "10", "11"])


def test_tensored_keys_need_few_minhashes():
    flat, bounds = near_dups.shingle_sets(pa.array([words(50, 1), words(50, 1) + " end", "", words(50, 2)]))
    left, right = near_dups.halves(flat, bounds)
    assert left.shape == right.shape == (4, near_dups.M) and not left[2].any()
    assert (left[0] == left[1]).any() and (right[0] == right[1]).any() and not (left[0] == left[3]).any()


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)]
    got = dict(near_dups.components(spark.createDataFrame(chain, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 90, 90: 90, 95: 90}


# Pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_are_the_librarys(spark, library):
    docs = awkward(spark)
    want = sorted((str(r[0]), str(library.encode(r[1] or ""))) for r in awkward_rows())
    for sent in (pieces.SENT_UNITS, 0):  # units sent to every task, and joined
        got = pieces.encode(docs, MODEL, sent_units=sent)
        assert sorted((str(r["doc_id"]), str(list(r["ids"]))) for r in got.collect()) == want
    texts = {str(r["doc_id"]): r["text"] for r in pieces.decode(pieces.encode(docs, MODEL), MODEL).collect()}
    assert texts == {str(r[0]): r[1] or "" for r in awkward_rows()}
    assert pieces.checked(docs, MODEL).where("not round_trip").count() == 0
    assert pieces.encode(empty(spark), MODEL).count() == 0 and pieces.encode(empty(spark), MODEL, sent_units=0).count() == 0


def test_pieces_of_random_texts(spark, library):
    r = random.Random(3)
    letters = "  abcdeintrs\n\r\t;){}▁é日😀\x00'=-_1"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(400)]
    got = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), MODEL).collect()
    assert {x["doc_id"]: list(x["ids"]) for x in got} == {i: library.encode(t) for i, t in enumerate(texts)}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abeinrst", min_size=1, max_size=200))
def test_long_units_merge_by_the_same_rule(library, unit):
    assert pieces.Pieces.of(MODEL).long(pieces.SPACE + unit) == library.encode(unit)


class Tiny:
    """A unigram vocabulary."""

    unigram, longest = True, 4
    normal = {p: (i, s) for i, (p, s) in enumerate([("a", -3.0), ("b", -3.5), ("ab", -4.0), ("aba", -6.0), ("ba", -4.2), ("bb", -9.0), ("abab", -7.5)])}


def test_viterbi_is_the_best_path(spark):
    r = random.Random(5)
    units = sorted({"".join(r.choice("abc") for _ in range(r.randint(2, 12))) for _ in range(60)})

    def best(unit):
        ways = [(0.0, [])]
        for end in range(1, len(unit) + 1):
            options = [(ways[end - 1][0] - 100, [*ways[end - 1][1], end])]
            for b in range(max(0, end - 4), end):
                if unit[b:end] in Tiny.normal:
                    options.append((ways[b][0] + Tiny.normal[unit[b:end]][1], [*ways[b][1], end]))
            ways.append(max(options, key=lambda o: o[0]))
        return ways[-1][0]

    def price(unit, cuts):
        total, begin = 0.0, 0
        for end in range(1, len(unit) + 1):
            if cuts >> end & 1:
                total += Tiny.normal[unit[begin:end]][1] if unit[begin:end] in Tiny.normal else -100
                begin = end
        return total

    got = pieces.lattice(spark.createDataFrame([(u,) for u in units], "unit string"), Tiny).select("unit", pieces.viterbi(floor=-100.0).alias("cuts")).collect()
    assert len(got) == len(units)
    assert all(abs(price(x["unit"], x["cuts"]) - best(x["unit"])) < 1e-9 for x in got)


# Licenses


def brute_licenses(text, templates, share):
    """License -> whether any place holds ``share`` of its shingles within its length and an eighth on each side."""

    def tokens(t):
        return [w for w in (x.strip(licenses.MARKS) for x in t.lower().split()) if w]

    have, out = tokens(text), set()
    for name, t in templates.items():
        need = [tuple(tokens(t)[i : i + 5]) for i in range(len(tokens(t)) - 4)]
        size, slack = len(need), max(1, len(need) // 8)
        all_ = [tuple(have[i : i + 5]) for i in range(len(have) - 4)]
        if any(len(set(need) & set(all_[max(0, s - slack) : s + size + slack])) / len(set(need)) >= share for s in range(len(all_))):
            out.add(name)
    return out


def test_notices_are_found_and_clean_text_is_not(spark):
    r = random.Random(6)
    rows = []
    for i in range(120):
        body = words(r.randint(0, 200), i).split()
        for name in r.sample(sorted(licenses.TEMPLATES), r.randint(0, 2)):
            notice = licenses.TEMPLATES[name].split()
            if r.random() < 0.3 and len(notice) > 30:
                notice[r.randrange(len(notice))] = "changed"
            at = r.randint(0, len(body))
            body[at:at] = [w.upper() if r.random() < 0.1 else w for w in notice]
        rows.append((i, " ".join(body)))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(x["doc_id"], x["license"]) for x in got}
    assert found == {(i, n) for i, t in rows for n in brute_licenses(t, licenses.TEMPLATES, licenses.CONTAINMENT)}
    text = dict(rows)
    for x in got:
        if x["license"] == "MIT":
            have = [w for w in (y.strip(licenses.MARKS) for y in text[x["doc_id"]].lower().split()) if w]
            assert have[x["start_word"] : x["end_word"] + 1] == "released under the mit license".split()


def test_licenses_of_awkward_rows(spark):
    assert licenses.scan(awkward(spark)).count() == 0 and licenses.scan(empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, "Released under the MIT License.\n" * 3), (1, "Released under the MIT License."), (None, "(Released under the MIT License)")], "doc_id long, text string")
    assert {tuple(r) for r in licenses.scan(twice).groupBy("doc_id").count().collect()} == {(1, 4), (None, 1)}
    with pytest.raises(ValueError):
        licenses.scan(twice, {"short": "four words are few"})


# Language


def lang_docs(spark, n=300):
    rows = [(i, sentences(("en", "fr", "de")[i % 3], 5 + i % 40, i), ("en", "fr", "de")[i % 3] if i % 7 else None, "s") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def brute_kneser_ney(texts):
    """gram -> cost of its last symbol, from counts in plain dictionaries; padded with gaps."""
    from collections import Counter

    top = Counter()
    for t in texts:
        for w in t.split():
            for run in re.findall(r"[^\W\d_]+", w):
                s = " " * (langid.ORDER - 1) + run.lower() + " "
                top.update(s[i : i + langid.ORDER] for i in range(len(s) - langid.ORDER + 1))
    tables = {langid.ORDER: top}
    for k in range(langid.ORDER - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    vocabulary = len(tables[1])

    def p(gram):
        out = 1 / (vocabulary + 1)
        for k in range(1, langid.ORDER + 1):
            table, tail = tables[k], gram[len(gram) - k :]
            n1, n2 = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            total = sum(c for g, c in table.items() if g[:-1] == tail[:-1])
            if total:
                kinds = sum(g[:-1] == tail[:-1] for g in table)
                out = max(0, table[tail] - d if tail in table else 0) / total + d * kinds / total * out
        return out

    return p, vocabulary


def test_costs_are_interpolated_kneser_ney(spark):
    docs = lang_docs(spark, 60).where("lang = 'en'")
    model = langid.train(docs)
    seen = [r["text"] for r in docs.where(~langid.held_out()).collect()]
    p, vocabulary = brute_kneser_ney(seen)
    grams = langid.grams_of(sentences("en", 12, 999).split() + ["zebra"])[0].tolist()
    for gram, cost in zip(grams, model.costs(grams)[:, 0], strict=True):
        assert cost == pytest.approx(-np.log(p(gram)), rel=1e-4), gram
    assert model.vocabulary == vocabulary + 1


def test_unseen_grams_are_not_priced_as_seen(spark):
    docs = lang_docs(spark, 60).where("lang = 'en'")
    model = langid.train(docs)
    texts = [r["text"] for r in docs.where(~langid.held_out()).collect()]
    p, _ = brute_kneser_ney(texts)
    seen = set(langid.grams_of(" ".join(texts).split())[0].tolist())
    letters = random.Random(5)
    grams = {"".join(letters.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(langid.ORDER)) for _ in range(200)} - seen
    grams = sorted(grams | {"".join(chr(ord(c) + 4095) if c.isalpha() else c for c in g) for g in sorted(seen)[:40]})
    for gram, cost in zip(grams, model.costs(grams)[:, 0], strict=True):
        assert cost == pytest.approx(-np.log(p(gram)), rel=1e-4), gram


def test_letters_of_all_planes_are_told_apart():
    words = ["\u4e2d", chr(0x4E2D + 4095), "\U00020000\U00020001x", "\U00020000", "Ab"]
    grams, place, firsts = langid.grams_of(words)
    of = [grams[place[a:b]].tolist() for a, b in zip(firsts, firsts[1:])]
    assert of[0] == ["    \u4e2d", "   \u4e2d "] and of[0][0] != of[1][0]
    assert of[2] == ["    \U00020000", "   \U00020000\U00020001", "  \U00020000\U00020001x", " \U00020000\U00020001x "]
    assert of[3][0] == of[2][0] and of[4] == ["    a", "   ab", "  ab "]
    assert len(set(grams.tolist())) == len(grams)


def test_word_numbers_of_texts_come_back_in_order():
    r = np.random.default_rng(0)
    for most in (3, 70_000, 10**6):
        for ends in ([0], [0, 0], [0, 5], [0, 0, 4, 4, 900, 900]):
            ends = np.array(ends)
            codes = r.integers(0, most, ends[-1])
            got = langid._unpacked(*langid._packed(codes, ends), ends)
            assert got.tolist() == [c for a, b in zip(ends, ends[1:]) for c in sorted(codes[a:b].tolist())]


def test_languages_do_not_depend_on_slices(spark, monkeypatch):
    """Many small slices give what one slice gives, words and n-grams beyond one byte's numbers included."""
    docs = lang_docs(spark, 400).coalesce(1)
    model = langid.train(docs)
    one = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    monkeypatch.setattr(langid, "BATCH", 700)
    for size in (1, 5_000):
        monkeypatch.setattr(langid, "SLICE", size)
        many = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
        assert many.keys() == one.keys()
        for i, r in many.items():
            assert r["lang_pred"] == one[i]["lang_pred"] and r["score"] == pytest.approx(one[i]["score"], abs=1e-6)


def test_accepted_keeps_clashing_columns_and_repeated_rows(spark):
    docs = lang_docs(spark, 90)
    odd = docs.where("doc_id < 3").withColumn("text", F.lit("xqzj vkpq zzxj qqkv " * 20))
    clash = docs.unionByName(odd).unionByName(docs.where("doc_id = 5"))
    for name in ("_grams", "_slice", "grams", "slice", "key", "codes", "_rejected", "digest"):
        clash = clash.withColumn(name, F.lit(7))
    got = langid.accepted(clash, langid.train(docs))
    assert got.columns == clash.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted([*range(90), 5])


def test_held_out_languages(spark):
    docs = lang_docs(spark)
    got = langid.predict(docs, langid.train(docs)).join(docs.where("lang is not null"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 50 and (held.lang_pred == held.lang).mean() > 0.98
    assert got.accepted.all() and got.score.between(0, 1).all()


def test_text_far_from_all_languages_is_rejected(spark):
    docs = lang_docs(spark)
    model = langid.train(docs)
    odd = spark.createDataFrame([(1, words(60, 1, "qxzjkvpy")), (2, "12 34 !!"), (3, sentences("fr", 30, 5))], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert not got[1]["accepted"] and not got[2]["accepted"] and got[2]["lang_pred"] == "und" and got[3]["accepted"]
    assert [r["doc_id"] for r in langid.accepted(odd, model).collect()] == [3]


def test_languages_of_awkward_rows(spark):
    docs = awkward(spark)
    got = [tuple(r)[:4] for r in langid.predict(docs, langid.train(docs)).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == len(awkward_rows()) and by[4][2:] == ("und", 0.0) and by[5][2] == by[6][2] == "und"
    assert {r[2] for r in got} <= {"en", "fr", "und"}
    nothing = langid.train(empty(spark))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.accepted(docs, langid.train(docs)).columns == docs.columns and langid.accepted(docs, nothing).count() == 0


# Quality


def quality_tables(spark, n=240):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        lines = [sentences("en", r.randint(4, 30), i * 50 + j).capitalize() + "." for j in range(r.randint(1, 9))]
        if bad:
            lines = [x.upper().replace(" ", "!! ") if i % 8 else " ".join([x.split()[0]] * 20) for x in lines]
            if r.random() < 0.3:
                lines[0] = sentences("en", 6, 1)
        rows.append((i, "\n".join(lines), "en", "s"))
        labels.append((i, 0 if bad else 1, 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_marginals_are_sums_over_all_labelings():
    r = np.random.default_rng(1)
    rows = np.array([0, 1, 4, 9])
    logits, jump = r.standard_normal(9), r.standard_normal((2, 2))
    got, pairs = quality.forward_backward(logits, rows, jump)
    want, want_pairs = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        total, good, both = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(1 << (b - a)):
            y = [code >> i & 1 for i in range(b - a)]
            w = np.exp(sum(logits[a + i] for i in range(b - a) if y[i]) + sum(jump[p, q] for p, q in zip(y, y[1:], strict=False)))
            total += w
            good += w * np.array(y)
            for p, q in zip(y, y[1:], strict=False):
                both[p, q] += w
        want[a:b] = good / total
        want_pairs += both / total
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_held_out_quality(spark):
    docs, labels = quality_tables(spark)
    got = quality.predict(docs, quality.train(docs, labels)).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 50 and (held.predicted == held["quality"]).mean() > 0.95
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_neighbouring_lines_are_features():
    features, sizes, rows = quality.line_features(pa.array(["AAAA!!\nbbb ccc", "x", ""]))
    own = (features.shape[1] - 3) // 3
    assert rows.tolist() == [0, 2, 3, 4] and sizes.tolist() == [7, 8, 2, 1]
    assert (features[1, 1 + own : 1 + 2 * own] == features[0, 1 : 1 + own]).all() and not features[2, 1 + own : 1 + 3 * own].any()


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 0, 0), (8, 1, 0), (9, None, 0), (None, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    for model in (quality.train(docs, labels), quality.train(docs, labels.limit(0)), quality.train(empty(spark), labels)):
        got = quality.predict(docs, model).toPandas()
        assert len(got) == len(awkward_rows()) and got.score.between(0, 1).all() and got.score.notna().all()
        assert quality.good(docs, model).columns == docs.columns
    assert quality.predict(empty(spark), model).count() == 0
    assert set(CLASHING) <= set(quality.good(docs, model).columns)


def test_a_doc_id_that_stands_for_several_texts_keeps_them_all(spark):
    a, b, c = (words(40, n) for n in (71, 72, 73))
    near = b.rsplit(" ", 1)[0]
    rows = [(1, a), (1, b), (2, b), (3, c), (4, near), (4, near), (5, ""), (5, None), (None, a), (6, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x"))
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_dups.deduplicate(docs).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 1, False), (4, 1, False), (5, 5, True), (5, 5, True), (6, 1, False)]
    kept = sorted(((r["doc_id"] or 0), r["text"] or "", r["row"]) for r in near_dups.distinct_documents(docs).collect())
    assert kept == sorted([(0, a, "x"), (1, a, "x"), (1, b, "x"), (3, c, "x"), (5, "", "x")])


def test_words_become_python_strings_a_block_at_a_time(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 16)
    known = [f"word{i}" for i in range(40)] + ["x" * 50, "y", "é"]
    blocks = list(langid._blocks(pa.array(known, pa.string())))
    assert [w for b in blocks for w in b] == known and max(len(b) for b in blocks) <= 4 and all(blocks)
    assert list(langid._blocks(pa.array([], pa.string()))) == []
    assert list(langid._blocks(pa.array([""], pa.string()))) == [[""]]


def test_freed_memory_is_given_back_after_each_slice(monkeypatch):
    from tidecast.llm import common

    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batch = pa.record_batch({"text": ["x" * 10] * 6})
    assert [s.num_rows for s in common.slices([batch], limit=20)] == [2, 2, 2]
    assert len(calls) == 3
