"""Spelling variants: a trie over letter counts finds words one edit apart, and rare words follow frequent ones to a root.

A word is described by how many of its letters fall into each of ``GROUPS`` letter groups. One inserted, deleted or replaced
letter changes these counts by a surplus of at most one and a deficit of at most one. Words are arranged in a trie of successive
counts: the length and the counts of the first ``TOP`` groups name a sub-trie, the other groups are its levels. A word visits
each sub-trie that it can reach within the budget, and a depth-first search spends what is left of it. Leaf words that
single letters still allow are verified letter by letter.

Of two near words only one visits the other: the shorter one, or the one with more letters of the earlier of the two groups
(with equal counts, the first in code-point order). A sub-trie with many words or visitors is cut into a grid of cells of
bounded size; each visitor meets each word in exactly one cell. No word is dropped and no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwell.llm.blocks import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a run; all of them are single bytes in Latin-1.
RUN = "[A-Za-zÀ-ÿ]+"
#: Levels of the trie, and those of them that name a sub-trie together with the length.
GROUPS, TOP = 12, 3
#: Most words, and most bytes of them, that one cell holds; most visitors, and bytes of them, that a cell takes.
CELL_WORDS, CELL_WORD_BYTES, CELL_VISITORS, CELL_VISITOR_BYTES = 16_384, 1 << 22, 131_072, 1 << 24
#: A node of so many words is searched as a leaf.
LEAF = 24
#: Letters that are compared side by side; longer words are compared one by one.
WIDE = 48

# Fixed value: letters by frequency, dealt to the groups in turn; other letters go by their code point.
_BY_FREQUENCY = "etaoinshrdlucmfwypvbgkjqxz"
_GROUP_OF = np.arange(256, dtype=np.int64) % GROUPS
_GROUP_OF[[ord(c) for c in _BY_FREQUENCY]] = np.arange(26) % GROUPS
_LETTERS = [chr(c) for c in [*range(0x61, 0x7B), *range(0xC0, 0x100)]]
#: One bit for each of the first four of a letter; accented letters share theirs by code point.
_SLOT = np.where(np.arange(256) < 0xC0, np.arange(256) % 32, 32 + np.arange(256) % 16).astype(np.int64)
_PLANES = 4

#: How a near word's (length, counts of the top groups) may differ from the visitor's, and the budget left below.
_MOVES = tuple(
    [(1, *(int(i == j) for j in range(TOP)), 0, 0) for i in range(TOP)] + [(1, *[0] * TOP, 1, 0), (0, *[0] * TOP, 1, 1)]
    + [(0, *(-int(i == j) for j in range(TOP)), 1, 0) for i in range(TOP)]
    + [(0, *(int(k == j) - int(k == i) for k in range(TOP)), 0, 0) for i in range(TOP) for j in range(i + 1, TOP)])
_KEY = ["size", *(f"g{i}" for i in range(TOP))]


def _occurrences(docs: DataFrame) -> DataFrame:
    """Every run of every text as a word, with the letter that its checksum takes away taken away."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), 0)).alias("run"))
    word = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    runs = runs.select("id", word.alias("word")).select("word", F.crc32(F.concat("id", F.lit(":"), "word")).alias("h"))
    at = F.pmod("h", F.char_length("word").cast("long")).cast("int")
    shorter = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
    return runs.select(F.when(F.col("h") % 97 == 0, shorter).otherwise(F.col("word")).alias("word"))


def count_words(docs: DataFrame, least_letters: int = 5, least: int = 3) -> DataFrame:
    """``docs`` (doc_id, text) to (word, n): words of enough letters that occur often enough in all texts."""
    words = _occurrences(docs).where(F.char_length("word") >= least_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _count_of(group: int) -> Column:
    own = "".join(c for c in _LETTERS if _GROUP_OF[ord(c)] == group)
    return F.char_length("word") - F.char_length(F.translate("word", own, ""))


def _places(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All letters of all words, and the word and the place of each."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    row = np.repeat(np.arange(len(words)), size)
    return np.frombuffer(b"".join(words), dtype=np.uint8), row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


class _Words:
    """Words of one side of a cell: counts by group, bits by letter, the first letters in a table."""

    def __init__(self, words: list[bytes], n: np.ndarray) -> None:
        letters, row, place = _places(words)
        self.words, self.n = words, n
        self.counts = np.bincount(row * GROUPS + _GROUP_OF[letters], minlength=len(words) * GROUPS).reshape(-1, GROUPS)
        slots = np.bincount(row * 48 + _SLOT[letters], minlength=len(words) * 48).reshape(-1, 48)
        powers = np.uint64(1) << np.arange(48, dtype=np.uint64)
        self.bits = np.stack([((slots > p) * powers).sum(axis=1, dtype=np.uint64) for p in range(_PLANES)], axis=1)
        near = place <= WIDE
        self.table = np.zeros((len(words), WIDE + 1), dtype=np.uint8)
        self.table[row[near], place[near]] = letters[near]
        self.size = np.array([len(w) for w in words], dtype=np.int64)


def _one_edit(a: bytes, b: bytes) -> bool:
    """Whether ``b`` is ``a`` with one letter replaced or one more."""
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :])


def _verified(guests: _Words, hosts: _Words, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which pairs of a guest and a host (as long, or one letter longer) are one edit apart."""
    ok = np.zeros(len(g), dtype=bool)
    longer = hosts.size[h] > guests.size[g]
    for low in range(0, len(g), 65_536):
        part = slice(low, low + 65_536)
        a, b = guests.table[g[part]], hosts.table[h[part]]
        same = a == b
        alike = (~same).sum(axis=1)
        first = np.where(alike > 0, same.argmin(axis=1), WIDE + 1)
        # one more letter: after the first difference, the guest's letters stand one place further on in the host
        moved = np.ones_like(same)
        moved[:, :-1] = a[:, :-1] == b[:, 1:]
        moved |= np.arange(WIDE + 1) < first[:, None]
        ok[part] = np.where(longer[part], moved.all(axis=1), alike == 1)
    wide = np.flatnonzero(hosts.size[h] > WIDE)
    ok[wide] = [_one_edit(guests.words[g[i]], hosts.words[h[i]]) for i in wide]
    return ok


def _search(guests: _Words, hosts: _Words, surplus: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (guest, host) near each other. Hosts stand in trie order; a node is a run of them with equal counts so far."""
    out_g: list[np.ndarray] = []
    out_h: list[np.ndarray] = []

    def leaf(low: int, high: int, who: np.ndarray, more: np.ndarray, less: np.ndarray) -> None:
        step = max(1, 200_000 // (high - low))
        for at in range(0, len(who), step):
            g = who[at : at + step]
            plus, minus = np.zeros((2, len(g), high - low), dtype=np.int64)
            for p in range(_PLANES):
                x, y = guests.bits[g, p][:, None], hosts.bits[low:high, p][None, :]
                plus += np.bitwise_count(y & ~x)
                minus += np.bitwise_count(x & ~y)
            i, j = np.nonzero((plus <= 1) & (minus <= 1))
            if len(i):
                out_g.append(g[i])
                out_h.append(j + low)

    def visit(level: int, low: int, high: int, who: np.ndarray, more: np.ndarray, less: np.ndarray) -> None:
        if high - low <= LEAF or level == GROUPS:
            leaf(low, high, who, more, less)
            return
        counts = hosts.counts[low:high, level]
        edges = np.concatenate([[0], np.flatnonzero(counts[1:] != counts[:-1]) + 1, [high - low]])
        own = guests.counts[who, level]
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            change = counts[s] - own
            may = (change <= more) & (-change <= less)
            if may.any():
                kept, change = who[may], change[may]
                visit(level + 1, low + s, low + e, kept, more[may] - np.maximum(change, 0), less[may] - np.maximum(-change, 0))

    visit(TOP, 0, len(hosts.words), np.arange(len(guests.words)), surplus, deficit)
    if not out_g:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g, h = np.concatenate(out_g), np.concatenate(out_h)
    keep = _verified(guests, hosts, g, h)
    return g[keep], h[keep]


def _cell(key: tuple, rows: pa.Table) -> pa.Table:
    home = rows.column("home").to_numpy()
    words = [w.encode("latin-1") for w in rows.column("word").to_pylist()]
    n = rows.column("n").to_numpy()
    at = np.flatnonzero(home)
    hosts = _Words([words[i] for i in at], n[at])
    order = np.lexsort(hosts.counts[:, TOP:][:, ::-1].T)
    hosts = _Words([hosts.words[i] for i in order], hosts.n[order])
    at = np.flatnonzero(~home)
    guests = _Words([words[i] for i in at], n[at])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(hosts.words) and len(guests.words):
        found.append(_search(guests, hosts, rows.column("more").to_numpy()[at], rows.column("less").to_numpy()[at]))
    g, h = found[0] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    both = rows.column("less").to_numpy()[at][g] > 0  # words of one sub-trie visit each other: the first in order counts
    pairs = [(i, j) for i, j, two in zip(g.tolist(), h.tolist(), both.tolist()) if not two or guests.words[i] < hosts.words[j]]
    g, h = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
    return pa.table([
        pa.array([guests.words[i].decode("latin-1") for i in g], pa.string()), pa.array(guests.n[g], pa.int64()),
        pa.array([hosts.words[i].decode("latin-1") for i in h], pa.string()), pa.array(hosts.n[h], pa.int64())], names=["u", "u_n", "v", "v_n"])


def near_words(words: DataFrame) -> DataFrame:
    """``words`` (word, n; distinct, of Latin-1 letters) to (u, u_n, v, v_n): each pair of words one edit apart, once."""
    keyed = stored(words.select("word", "n", F.char_length("word").alias("size"), *(_count_of(i).alias(f"g{i}") for i in range(TOP))), "words-by-count")
    moves = F.array(*(
        F.struct(*((F.col(c) + F.lit(d)).alias(c) for c, d in zip(_KEY, move)), F.lit(move[-2]).alias("more"), F.lit(move[-1]).alias("less"))
        for move in _MOVES))
    guests = keyed.select("word", "n", F.explode(moves).alias("to")).select("word", "n", "to.*")
    guests = guests.where(" and ".join(f"g{i} >= 0" for i in range(TOP)))
    weight = F.sum(F.char_length("word"))
    homes = keyed.groupBy(*_KEY).agg(F.ceil(F.greatest(F.count("*") / CELL_WORDS, weight / CELL_WORD_BYTES)).cast("int").alias("home_cells"))
    came = guests.groupBy(*_KEY).agg(F.ceil(F.greatest(F.count("*") / CELL_VISITORS, weight / CELL_VISITOR_BYTES)).cast("int").alias("guest_cells"))
    grid = stored(homes.join(came, _KEY), "cells")

    def spread(rows: DataFrame, home: bool) -> DataFrame:
        """A word stands in its own row of cells, a visitor in its own column."""
        own, other = ("home_cell", "guest_cell") if home else ("guest_cell", "home_cell")
        rows = rows.join(grid, _KEY).withColumn(own, F.pmod(F.xxhash64("word"), F.col(f"{own}s")).cast("int"))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
        return rows.select(*_KEY, "home_cell", "guest_cell", "word", "n", F.lit(home).alias("home"), "more", "less")

    rows = spread(keyed.withColumn("more", F.lit(0)).withColumn("less", F.lit(0)), True).union(spread(guests, False))
    return rows.groupBy(*_KEY, "home_cell", "guest_cell").applyInArrow(_cell, "u string, u_n long, v string, v_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form) to (word, root). A form occurs at least twice as often as its word, so chains are short and have
    no cycle; each round doubles the steps that a word has gone."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_groups(docs: DataFrame, least_letters: int = 5, least: int = 3, ratio: int = 2) -> DataFrame:
    """``docs`` (doc_id, text, ...) to (word, form, root, n, n_near, form_n), a row for each word.

    Runs of letters (A-Z in lower case) are words; a run whose checksum with its doc_id is divisible by 97 loses the letter that
    the checksum names. Words have ``least_letters`` letters and ``least`` occurrences or more. A word's form is its near word of
    largest n (ties: the first in code-point order) if that n is ``ratio`` times the word's or more, else null; its root is
    the end of the chain of forms, the word itself if it has none. ``ratio`` must be above 1.

    Null and empty texts have no words; a null doc_id counts as an empty one. Repeated rows count as often as they stand there, other
    columns are ignored, an empty table gives an empty result. Jobs run when this is called.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1, or chains of forms could go in circles")
    words = stored(count_words(docs, least_letters, least), "words")
    pairs = stored(near_words(words), "near-words")
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("u").alias("word"), F.col("u_n").alias("n"), F.col("v").alias("near"), F.col("v_n").alias("near_n")),
        F.struct(F.col("v").alias("word"), F.col("v_n").alias("n"), F.col("u").alias("near"), F.col("u_n").alias("near_n")))).alias("p")).select("p.*")
    best = F.min(F.when(F.col("near_n") >= ratio * F.col("n"), F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("form"))))
    chosen = stored(both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")).select(
        "word", "n_near", "best.form", (-F.col("best.k")).alias("form_n")), "forms")
    roots = _roots(chosen.where("form is not null"))
    return words.join(chosen, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
