"""Leak search against the subsequence rule over all windows of all documents."""

import random
import re

import numpy as np
import pyarrow as pa

from clearwell.llm import latent_leaks as leaks
from clearwell.llm.blocks import in_levels


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    out = {}
    for d, text in docs:
        for i, item in items:
            have, want = words(text), words(item)
            if d is None or len(want) < leaks.LEAST_WORDS:
                continue
            n, _ = leaks.window_of(len(want))
            room = (1 + max(0, -(-(len(want) - n) // leaks.STEP))) * leaks.STEP
            for s in range(0, len(have), leaks.STEP):
                held = have[max(0, s - room) : s + n + room]
                share = longest(want, held) / len(want)
                if share >= leaks.COVERED and longest(want[-leaks.ANSWER_WORDS :], held) >= leaks.ANSWER_COVERED * leaks.ANSWER_WORDS:
                    out[d, i] = max(out.get((d, i), 0), share)
    return out


def fixture():
    rng = random.Random(12)
    vocabulary = ["the", "of", "and", "to"] * 6 + [f"w{i}x" for i in range(60)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([3, 5, 6, 9, 14, 20, 31, 40, 40])]
    items += [(20, "the of and the of and to the of"), (21, items[5][1]), (22, "w1x " * 12)]
    docs = []
    for d in range(60):
        text = say(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            copy = rng.choice(items)[1].split()
            for _ in range(rng.randrange(1 + len(copy) // 3)):
                k = rng.randrange(len(copy))
                copy[k : k + rng.randrange(2)] = say(rng.randrange(2))
            at = rng.randrange(len(text) + 1)
            text[at:at] = copy
        docs.append((d, ", ".join(text)))
    return docs + [(100, None), (101, ""), (None, items[7][1]), (102, "of " * 30_000 + items[7][1] + " and" * 20_000)], items


def found(spark, docs, items, **how):
    rows = leaks.find_leaks(spark.createDataFrame(docs + docs[:5], "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), **how)
    return {(r.doc_id, r.item_id): r.covered for r in rows.collect()}


def test_leaks_equal_all_windows(spark):
    """With no bound on the cosine, exactly the pairs and covers of all windows; with it, none that is not one of them."""
    docs, items = fixture()
    want = brute(docs, items)
    assert len(want) > 40
    got = found(spark, docs, items, cosine=-1.0)
    assert got == {k: v for k, v in want.items()}
    bounded = found(spark, docs, items)
    assert set(bounded) <= set(want) and {k for k, v in want.items() if v == 1.0 and len(words(dict(items)[k[1]])) > 8} <= set(bounded)


def test_a_leak_has_rare_words():
    """Whatever may be missing, as many places of an item's rare words as are needed are left."""
    rng = random.Random(3)
    for _ in range(200):
        item = np.array([rng.randrange(1, 30) << 58 | rng.randrange(4) for _ in range(rng.randrange(1, 40))], dtype=np.uint64)
        key, owner = leaks.rare_words([item], np.random.default_rng(1).random(leaks.TERMS), 0.75)
        rare = sum(w in set(key.tolist()) for w in item.tolist())
        may_miss = len(item) - int(np.ceil(0.75 * len(item)))
        assert rare - may_miss >= leaks.needed(len(item), 0.75) >= 1 and (owner == 0).all()


def test_parts_are_added_in_levels(spark):
    """Many tasks' parts are added by tasks that see a bounded number of them."""
    def part(batches):
        for b in batches:
            yield pa.record_batch([pa.array(["a", "b"]), pa.array([float(b.num_rows), 1.0])], names=["k", "v"])

    def add(key, rows):
        assert len(rows) <= 40
        return pa.table({"k": [key[0].as_py()], "v": [sum(rows.column("v").to_pylist())]})

    parts = spark.range(0, 2000, 1, 700).mapInArrow(part, "k string, v double")
    assert sorted(in_levels(parts, ["k"], add, "k string, v double").collect()) == [("a", 2000.0), ("b", 700.0)]
