"""Spelling groups, phrase mining and quality rules against brute force, on odd rows and on empty tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clearwell.llm import phrase_mining, quality_rules, spelling_groups

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", None) for d, t, lang in rows], DOCS)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# spelling groups


def variants(seed, n):
    """Words that differ by an edit or two, of a small alphabet with accents, at very different counts."""
    rng = random.Random(seed)
    letters = "abeioßéèü" + "st"
    words = []
    for _ in range(n):
        base = [rng.choice(letters) for _ in range(rng.randrange(4, 9))]
        words += ["".join(base)] * rng.randrange(1, 40)
        for _ in range(rng.randrange(0, 8)):
            w = list(base)
            for _ in range(rng.randrange(1, 3)):
                i = rng.randrange(len(w))
                w[i : i + rng.randrange(0, 2)] = [rng.choice(letters) for _ in range(rng.randrange(0, 2))]
                w = w or ["a"]
            words += ["".join(w)] * rng.randrange(1, 12)
    rng.shuffle(words)
    return words


def brute_spelling(rows):
    n = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = [len(close)]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, n[w], out[w][0], n[form[w]] if form[w] else None)
    return sorted(out.values())


def found_spelling(spark, rows):
    return sorted(tuple(r) for r in spelling_groups.spelling_groups(table(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("limits", [None, (40, 60)])
def test_spelling_groups_equal_brute_force(spark, monkeypatch, limits):
    if limits:  # many cells for each sub-trie, and nodes that are searched level by level
        monkeypatch.setattr(spelling_groups, "CELL_WORDS", limits[0])
        monkeypatch.setattr(spelling_groups, "CELL_VISITORS", limits[1])
    words = variants(3, 120)
    rows = [(i, " ".join(words[i :: 40]) + " Don't x2y", "en") for i in range(40)]
    rows += [(None, "Straße straße STRAßE Straße", "de"), (7, "Straße, Strasse; Strasse Strasse", "de")]
    assert found_spelling(spark, rows) == brute_spelling(rows)


def test_spelling_search_by_levels(monkeypatch):
    """The depth-first search itself, with leaves of one word, against all pairs."""
    monkeypatch.setattr(spelling_groups, "LEAF", 1)
    words = sorted({w for w in variants(5, 150) if len(w) > 3})
    rows = [(w, 1, len(w), *(sum(spelling_groups._GROUP_OF[b] == g for b in w.encode("latin-1")) for g in range(spelling_groups.TOP))) for w in words]
    got = set()
    for move in spelling_groups._MOVES:
        keys = {tuple(r[2 + i] + move[i] for i in range(4)) for r in rows}
        for key in keys:
            homes = [(r[0], True, 0, 0) for r in rows if r[2:] == key]
            guests = [(r[0], False, move[-2], move[-1]) for r in rows if tuple(r[2 + i] + move[i] for i in range(4)) == key]
            cell = pa.table({"home": [x[1] for x in homes + guests], "word": [x[0] for x in homes + guests], "n": [1] * len(homes + guests),
                             "more": np.array([x[2] for x in homes + guests], np.int32), "less": np.array([x[3] for x in homes + guests], np.int32)})
            pairs = [tuple(sorted(p)) for p in zip(*(spelling_groups._cell((), cell).column(c).to_pylist() for c in "uv"))]
            assert not got & set(pairs) and len(set(pairs)) == len(pairs)  # each pair once
            got |= set(pairs)
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if _distance_one(a, b)}
    assert got == want and len(want) > 50


def _distance_one(a, b):
    a, b = sorted((a, b), key=len)
    return spelling_groups._one_edit(a.encode("latin-1"), b.encode("latin-1")) if len(b) - len(a) <= 1 else False


def test_spelling_odd_rows(spark):
    long_word = "langeswort" * 2000
    rows = [(1, None, "en"), (2, "", None), (3, " 12 ... ", "en")] + 2 * [(4, f"{long_word} {long_word[:-1]} abcde abcdf " * 3, "en")]
    got = found_spelling(spark, rows)
    assert got == brute_spelling(rows)
    assert {r[0]: r[4] for r in got}[long_word] == 1
    assert found_spelling(spark, rows[:3]) == []
    assert spelling_groups.spelling_groups(spark.createDataFrame([], "doc_id long, text string, word string, n long")).count() == 0
    with pytest.raises(ValueError):
        spelling_groups.spelling_groups(table(spark, rows), ratio=1)


def test_spelling_chain_of_forms(spark):
    """Each word's form is the next one; the root is the end of the chain."""
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]
    text = " ".join(w for i, w in enumerate(chain) for _ in range(3 * 2**i))
    got = {r[0]: r for r in found_spelling(spark, [(10**6, text, "en")])}
    want = {r[0]: r for r in brute_spelling([(10**6, text, "en")])}
    assert got == want and {got[w][2] for w in chain} == {"bbbbb"}


# phrases


def brute_phrases(rows, limit, least, inside=50):
    grams, size = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(text)):
            words = re.findall("[^\x20\x09]+", piece)
            size[lang] += len(words)
            for k in (1, 2, 3):
                grams.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for g, a in grams.items():
        if len(g) < 3 or a < least:
            continue
        cuts = []
        for k in range(1, len(g) - 1):
            l, r = grams[g[: k + 1]], grams[(g[0], *g[k + 1 :])]
            cuts.append((1_000_000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        if len(g) == 3 and any(b >= least and 100 * b >= inside * a for x, b in grams.items()
                               if len(x) == 4 and x[0] == g[0] and g[1:] in (x[1:3], x[2:4])):
            continue
        out.append((g[0], -score, -a, " ".join(g[1:]).encode(), l, r))
    best = []
    for lang in sorted({x[0] for x in out}):
        for rank, (_, s, a, p, l, r) in enumerate(sorted(x for x in out if x[0] == lang)[:limit], 1):
            best.append((lang, rank, p.decode(), -a, l, r, size[lang], -s))
    return best


def found_phrases(spark, rows, **how):
    got = phrase_mining.mine_phrases(table(spark, rows), **how)
    return sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def said(seed, n):
    """Texts of a skewed vocabulary with set phrases and ties."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    fixed = [["New", "York", "City"], ["in", "spite", "of"], ["ad", "hoc"], ["vice", "versa"], ["le", "été"], ["a", "a", "a"], ["x", "x"]]
    rows = []
    for d in range(n):
        out = []
        for _ in range(rng.randrange(0, 60)):
            out += rng.choice(fixed) if rng.random() < 0.3 else [words[min(39, int(rng.expovariate(0.2)))]]
            if rng.random() < 0.1:
                out[-1] += rng.choice([".", ",", "!", "\n", "\x0b", "\r\n", ":"])
        rows.append((d, rng.choice([" ", "  ", "\t"]).join(out), rng.choice(["en", "fr", None, "und"])))
    return rows


@pytest.mark.parametrize("limit, first", [(2000, 2), (5, 1), (1, 1), (12, 0.1)])
def test_phrases_equal_brute_force(spark, monkeypatch, limit, first):
    """Small limits need several frontiers: pairs high up are dropped for the longer phrases around them."""
    monkeypatch.setattr(phrase_mining, "FIRST", first)
    monkeypatch.setattr(phrase_mining, "STEP", 2)
    rows = said(limit, 120)
    assert found_phrases(spark, rows, limit=limit) == brute_phrases(rows, limit, 10)


def test_phrases_maps_that_let_all_through(spark, monkeypatch):
    monkeypatch.setattr(phrase_mining, "MAP_BITS", 1 << 15)
    monkeypatch.setattr(phrase_mining, "HASHES", 50)
    rows = said(9, 60)
    assert found_phrases(spark, rows, limit=20, least=4) == brute_phrases(rows, 20, 4)


def test_long_texts_go_in_segments(monkeypatch):
    """Segments that end in a piece carry two words on, and count nothing twice."""
    monkeypatch.setattr(phrase_mining, "BLOCK_BYTES", 50)
    rng = random.Random(1)
    for text in [" ".join(rng.choice(["a", "bb", "c.", "d\n", "été", "x" * 70]) for _ in range(400)), "y" * 300, "z " * 90, " . " * 90, "q" * 120 + " r s"]:
        batch = pa.record_batch([pa.array([text]), pa.array(["en"])], names=["text", "lang"])
        for n in (1, 2, 3):
            got, want = Counter(), Counter()
            for segment in phrase_mining._segments(iter([batch])):
                block = phrase_mining._Block(*segment)
                out = block.counted(block.runs(n), n).to_pydict()
                for i, f in enumerate(out["f"]):
                    got[tuple(out[f"w{k + 1}"][i] for k in range(n))] += f
            for piece in re.split("[.,;:!?\x0a-\x0d]", text):
                words = re.findall("[^\x20\x09]+", piece)
                want.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
            assert got == want


def test_phrases_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", None), (3, " .,\t", "fr")]
    assert found_phrases(spark, rows) == []
    rows += 12 * [(4, "Same Words here", None)]  # repeated rows, ties: all phrases at the same score and count
    assert found_phrases(spark, rows) == brute_phrases(rows, 2000, 10)
    assert phrase_mining.mine_phrases(spark.createDataFrame([], "text string, lang string, phrase string, score long")).count() == 0


def test_score_is_exact_beyond_64_bits(spark):
    a, l, r = 10**13 - 7, 10**13 + 11, 10**13 + 3
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(phrase_mining.score("a", "l", "r").alias("s")).first()
    assert row.s == 1_000_000 * a * a // (l * r)


# quality rules


def brute_quality(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n, chars, symbols, dup, again = len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)
    failed = n < 20 or 100 * again > 30 * n
    upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    letters = sum(any(c.isalpha() for c in w) for w in words)
    kept = not (failed or 10 * symbols > n or chars < 2 * n or chars > 12 * n or 2 * dup > len(lines) or upper > lower or 10 * letters < 7 * n)
    return n, chars, symbols, dup, again, failed, kept


def texts(seed, n):
    rng = random.Random(seed)
    plain = lambda k: [rng.choice(["the", "house", "stands", "été", "naïve", "on", "Hill"]) + rng.choice(["", "", ".", ","]) for _ in range(k)]
    out = [None, "", " \n\t", "\n\n\n", "x", "été " * 25, "a\x0bb\x0cc\r\nd " * 9]
    for _ in range(n):
        words = plain(rng.randrange(5, 120))
        kind = rng.randrange(8)
        if kind == 1:
            words = [w + "***" for w in words]
        elif kind == 2:
            words = [w.upper() + "!!" for w in words]
        elif kind == 3:
            words = words[:9] * 8
        elif kind == 4:
            words = [str(rng.randrange(100)) for _ in words]
        elif kind == 5:
            words = ["w" * 40 if rng.random() < 0.4 else w for w in words]
        line = rng.randrange(3, 15)
        lines = [" ".join(words[i : i + line]) for i in range(0, len(words), line)]
        out.append("\n".join(lines * (3 if kind == 6 else 1)))
    return out


def test_quality_equals_brute_force(spark):
    rows = [(i, t, "en") for i, t in enumerate(texts(2, 300))]
    got = {r[0]: tuple(r)[1:] for r in quality_rules.judge(table(spark, rows)).collect()}
    want = {d: brute_quality(t) for d, t, _ in rows}
    assert got == want
    assert 40 < sum(w[-1] for w in want.values()) < 260


def test_quality_in_any_order(spark):
    """The order of rules steers the work alone: every order keeps the same rows, and rules see only rows that are still in."""
    some = pa.array([t for t in texts(4, 120)], pa.string())
    rng, want = random.Random(0), [brute_quality(t)[-1] for t in some.to_pylist()]
    for _ in range(20):
        rules = list(quality_rules.RULES)
        rng.shuffle(rules)
        kept, tried = quality_rules._cascade(quality_rules.Texts(some), rules, np.ones(len(some), dtype=bool))
        assert kept.tolist() == want
        assert (tried[kept] == len(rules)).all() and tried[~kept].min() == 1
    rows = [(i, t, "en") for i, t in enumerate(some.to_pylist())]
    good = quality_rules.keep_good(table(spark, rows + rows[:50]))
    assert good.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in good.collect()) == sorted([i for i, w in enumerate(want) if w] + [i for i, w in enumerate(want[:50]) if w])


def test_rules_are_ordered_by_rejections_per_cost():
    rule = lambda name, *features: quality_rules.Rule(name, features, None, "")
    rules = (rule("slow", "n_repeat_words"), rule("cheap", "n_symbols"), rule("idle", "n_lines"), rule("same", "n_upper"))
    seconds = {"words": 5.0, "bytes": 1.0, "n_repeat_words": 10.0, "n_symbols": 1.0, "n_lines": 1.0, "lines": 1.0, "n_upper": 1.0}
    # "cheap" rejects 30 for 2 s, "slow" 60 for 16 s; all that "same" rejects is out behind "cheap"; "idle" rejects nothing
    costs = quality_rules.Costs(seconds, {0b0001: 50, 0b0011: 10, 0b1010: 20, 0: 20})
    assert [rules[i].name for i in quality_rules.order_rules(rules, costs)] == ["cheap", "slow", "idle", "same"]
    assert sorted(quality_rules.order_rules(rules, quality_rules.Costs({}, {}))) == [0, 1, 2, 3]


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    """With a hash that says nothing, windows are compared by their words."""
    monkeypatch.setattr(quality_rules, "hash_strings", lambda words: np.zeros(len(words), dtype=np.uint64))
    some = texts(6, 40)
    got = quality_rules.Texts(pa.array(some, pa.string()))["n_repeat_words"].tolist()
    assert got == [brute_quality(t)[4] for t in some]


def test_quality_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS + ", kept string, n_words string")
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep_good(empty).count() == 0
    clash = table(spark, [(None, "a b", None), (1, "word " * 200_000, "en")]).withColumn("kept", F.lit("x"))
    got = {r.doc_id: r for r in quality_rules.judge(clash).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].kept) == (200_000, 200_000, False) and not got[None].kept
