"""Quality rules as a short-circuit cascade: the rule that rejects most for its cost goes first.

A rule is a comparison of counts (features) of a text. What a rule costs is what its features cost, and that can't be known
beforehand: it hangs on the texts. So every feature is timed on a sample of the rows, and each sampled row's failed rules are noted.
From these, rules are ordered greedily: next comes the rule with the most rejections, among the sampled rows that are still in, for
each second that its features would take on them. In the main pass a rule sees only rows that no rule before it has
rejected, and a feature is computed when the first rule that needs it is reached, for these rows.

The order steers the work alone. A row is kept if no rule rejects it, whatever the order, so the outcome does not
depend on the sample or on clocks.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearwell.llm.blocks import hash_strings, mixed, text_blocks

#: Rows, about, that costs and selectivities are estimated on.
SAMPLE = 20_000
WINDOW = 8

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[*b"#*$%&|<>"]] = True
_CONTINUES = np.arange(256) & 0xC0 == 0x80
_UPPER, _LOWER = [(np.arange(256) >= a) & (np.arange(256) <= b) for a, b in ((0x41, 0x5A), (0x61, 0x7A))]
_WINDOW_MIX = np.random.default_rng(13).integers(1, 2**63, WINDOW + 1, dtype=np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """``rejects`` takes one array for each of ``features`` and says which rows fail; ``sql`` is the same condition."""

    name: str
    features: tuple[str, ...]
    rejects: Callable[..., np.ndarray]
    sql: str


BASE = (
    Rule("few_words", ("n_words",), lambda n: n < 20, "n_words < 20"),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 30 * n, "100 * n_repeat_words > 30 * n_words"),
)
RULES = BASE + (
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 10 * s > n, "10 * n_symbols > n_words"),
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: (c < 2 * n) | (c > 12 * n), "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    Rule("duplicate_lines", ("n_lines", "n_dup_lines"), lambda n, d: 2 * d > n, "2 * n_dup_lines > n_lines"),
    Rule("shouting", ("n_upper", "n_lower"), lambda u, l: u > l, "n_upper > n_lower"),
    Rule("no_letters", ("n_words", "n_letter_words"), lambda n, a: 10 * a < 7 * n, "10 * n_letter_words < 7 * n_words"),
)


class Texts:
    """The texts of a block. Features are computed once, for the rows that are still in when they are first asked for."""

    def __init__(self, texts: pa.Array) -> None:
        self.all = pc.fill_null(texts.cast(pa.string()), "")
        self.size = len(self.all)
        self.rows = np.arange(self.size)
        self._kept: dict[str, object] = {}
        self.seconds: dict[str, float] = {}

    def narrow(self, rows: np.ndarray) -> None:
        """From now on only ``rows`` are asked about; what is there already is kept."""
        self.rows = rows

    def __getitem__(self, name: str) -> np.ndarray:
        """A feature for all rows of the block; only those of ``rows`` mean something."""
        return self._part(name)

    def _part(self, name: str):
        if name not in self._kept:
            before = dict(self.seconds)
            start = time.thread_time()
            self._kept[name] = getattr(self, f"_{name}")()
            inner = sum(self.seconds.values()) - sum(before.values())
            self.seconds[name] = time.thread_time() - start - inner
        return self._kept[name]

    def _spread(self, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size, dtype=np.int64)
        out[rows] = values
        return out

    def _bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, their bytes one after another, and where each row's begin."""
        rows = self.rows
        texts = self.all if len(rows) == self.size else self.all.take(pa.array(rows))
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        return rows, np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]

    def _per_row(self, marked: np.ndarray) -> np.ndarray:
        rows, _, offsets = self._part("bytes")
        return self._spread(rows, np.diff(np.searchsorted(np.flatnonzero(marked), offsets)))

    def _words(self) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Rows, distinct words, the code of each word of all rows, and where each row's words begin."""
        rows, data, offsets = self._part("bytes")
        inside = ~_SPACE[data]
        first = np.zeros(len(data) + 1, dtype=bool)
        first[offsets] = True
        start = inside & first[:-1]
        start[1:] |= inside[1:] & ~inside[:-1]
        at = np.flatnonzero(start)
        ends = np.append((np.cumsum(inside, dtype=np.int32) - 1)[at], int(inside.sum())).astype(np.int32)
        words = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[inside]))).dictionary_encode()
        return rows, words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(at, offsets)

    def _n_words(self) -> np.ndarray:
        rows, _, _, begins = self._part("words")
        return self._spread(rows, np.diff(begins))

    def _word_chars(self) -> np.ndarray:
        data = self._part("bytes")[1]
        return self._per_row(~_SPACE[data] & ~_CONTINUES[data])

    def _n_symbols(self) -> np.ndarray:
        return self._per_row(_SYMBOL[self._part("bytes")[1]])

    def _n_upper(self) -> np.ndarray:
        return self._per_row(_UPPER[self._part("bytes")[1]])

    def _n_lower(self) -> np.ndarray:
        return self._per_row(_LOWER[self._part("bytes")[1]])

    def _n_letter_words(self) -> np.ndarray:
        rows, words, codes, begins = self._part("words")
        has = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(has[codes] if len(words) else np.zeros(0, np.int64))])
        return self._spread(rows, np.diff(before[begins]))

    def _lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, and for each line with a word its row's number among these and its code."""
        rows = self.rows
        lists = pc.split_pattern(self.all.take(pa.array(rows)), "\n")
        lines = lists.flatten()
        owner = np.repeat(np.arange(len(rows)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
        codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return rows, owner[full], codes[full]

    def _n_lines(self) -> np.ndarray:
        rows, owner, _ = self._part("lines")
        return self._spread(rows, np.bincount(owner, minlength=len(rows)))

    def _n_dup_lines(self) -> np.ndarray:
        rows, owner, codes = self._part("lines")
        distinct = np.unique(owner * (codes.max(initial=0) + 1) + codes) // (codes.max(initial=0) + 1)
        return self._spread(rows, np.bincount(owner, minlength=len(rows)) - np.bincount(distinct, minlength=len(rows)))

    def _n_repeat_words(self) -> np.ndarray:
        """Words that stand in a window of ``WINDOW`` words which the row has twice or more."""
        rows, words, codes, begins = self._part("words")
        n = max(0, len(codes) - WINDOW + 1)
        owner = np.repeat(np.arange(len(rows)), np.diff(begins))
        at = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :]) if n else np.zeros(0, np.int64)
        hashes = hash_strings(words)
        key = owner[at].astype(np.uint64) * _WINDOW_MIX[WINDOW]
        for i in range(WINDOW):
            key = mixed(key + hashes[codes[at + i]] * _WINDOW_MIX[i])
        order = np.argsort(key, kind="stable")
        again = np.flatnonzero(key[order][1:] == key[order][:-1])
        a, b = at[order[again]], at[order[again + 1]]
        same = owner[a] == owner[b]
        for i in range(WINDOW):
            same &= codes[a + i] == codes[b + i]
        if not same.all():  # two windows of one hash: tell them apart by their words
            seen: dict[tuple, int] = {}
            a, b = [], []
            for x in at.tolist():
                one = seen.setdefault((owner[x], *codes[x : x + WINDOW].tolist()), x)
                if one != x:
                    a.append(one)
                    b.append(x)
            a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        edge = np.zeros(len(codes) + 1, dtype=np.int64)
        hit = np.unique(np.concatenate([a, b]))
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + WINDOW, -1)
        covered = np.cumsum(edge[:-1]) > 0
        return self._spread(rows, np.bincount(owner[covered], minlength=len(rows)))


@dataclass(frozen=True)
class Costs:
    """Seconds of each feature over the sampled rows, and how many of these fail each set of rules (bit i: rule i)."""

    seconds: dict[str, float]
    failed: dict[int, int]


def estimate(docs: DataFrame, rules: tuple[Rule, ...], sample: int = SAMPLE) -> Costs:
    """Time every feature and try every rule on about ``sample`` rows of ``docs``, chosen by a hash of the text.

    Tasks send their seconds by feature and their counts by set of failed rules, at most 2^rules rows in all.
    """
    share = max(1, docs.count() // sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds: dict[str, float] = {}
        failed: dict[int, int] = {}
        for batch in text_blocks(batches):
            texts = Texts(batch.column("text"))
            bits = sum(rule.rejects(*(texts[f] for f in rule.features)).astype(np.int64) << i for i, rule in enumerate(rules))
            for x, n in zip(*(v.tolist() for v in np.unique(bits, return_counts=True))):
                failed[x] = failed.get(x, 0) + n
            for f, s in texts.seconds.items():
                seconds[f] = seconds.get(f, 0.0) + s
        yield pa.record_batch(
            [pa.array([*seconds, *[None] * len(failed)], pa.string()), pa.array([*[None] * len(seconds), *failed], pa.int64()),
             pa.array([*seconds.values(), *(float(n) for n in failed.values())], pa.float64())], names=["feature", "bits", "value"])

    rows = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    found = rows.mapInArrow(run, "feature string, bits long, value double").groupBy("feature", "bits").agg(F.sum("value").alias("value")).collect()
    return Costs({r.feature: r.value for r in found if r.feature}, {r.bits: int(r.value) for r in found if r.feature is None and r.bits is not None})


#: Features that others are computed from.
_NEEDS = {"n_words": ("words",), "words": ("bytes",), "word_chars": ("bytes",), "n_symbols": ("bytes",), "n_upper": ("bytes",), "n_lower": ("bytes",),
          "n_letter_words": ("words",), "n_repeat_words": ("words",), "n_lines": ("lines",), "n_dup_lines": ("lines",)}


def _all_needs(features: tuple[str, ...]) -> set[str]:
    out = set(features)
    for f in features:
        out |= _all_needs(_NEEDS.get(f, ()))
    return out


def order_rules(rules: tuple[Rule, ...], costs: Costs) -> list[int]:
    """Numbers of ``rules``, greedily by rejections for each second; ties and rules that reject nothing by their number."""
    total = max(1, sum(costs.failed.values()))
    left, ready, order = dict(costs.failed), set(), []
    while len(order) < len(rules):
        alive = max(1, sum(left.values()))

        def worth(i: int) -> tuple[float, int]:
            new = _all_needs(rules[i].features) - ready
            # a rule's own comparison costs next to nothing beside its features
            seconds = 1e-9 + sum(costs.seconds.get(f, 0.0) for f in sorted(new)) * alive / total
            return sum(n for bits, n in left.items() if bits >> i & 1) / seconds, -i

        best = max((i for i in range(len(rules)) if i not in order), key=worth)
        order.append(best)
        ready |= _all_needs(rules[best].features)
        left = {bits: n for bits, n in left.items() if not bits >> best & 1}
    return order


def _cascade(texts: Texts, rules: list[Rule], alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows no rule rejects, and how many rules each row went through."""
    kept = alive.copy()
    tried = np.zeros(texts.size, dtype=np.int64)
    for rule in rules:
        rows = np.flatnonzero(kept)
        if not len(rows):
            break
        texts.narrow(rows)
        tried[rows] += 1
        kept[rows] = ~rule.rejects(*(texts[f][rows] for f in rule.features))
    return kept, tried


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, sample: int = SAMPLE) -> DataFrame:
    """``docs`` (doc_id, text, ...) to (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a
    row for each row.

    All measures are taken of every row; rows that fail a rule of ``base`` go no further, the others through the cascade of the
    rest of ``rules``. Words stand between ASCII white space. ``word_chars`` are code points in words, ``n_symbols``
    characters of ``#*$%&|<>``, ``n_dup_lines`` lines with a word that equal an earlier line, ``n_repeat_words`` words
    in windows of eight words found twice or more. ``kept`` says that no rule rejects the row.

    A null or empty text has no words and fails. Equal texts have equal outcomes, repeated rows give repeated rows; other columns are
    ignored; an empty table gives an empty result. The costs are estimated when this is called.
    """
    rest = tuple(r for r in rules if r not in base)
    ordered = [rest[i] for i in order_rules(rest, estimate(docs, rest, sample))] if rest else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            texts = Texts(batch.column("text"))
            measures = [texts[m] for m in MEASURES]
            failed = np.zeros(texts.size, dtype=bool)
            for rule in base:
                failed |= rule.rejects(*(texts[f] for f in rule.features))
            kept, _ = _cascade(texts, ordered, ~failed)
            yield pa.record_batch([batch.column("doc_id"), *map(pa.array, measures), pa.array(failed), pa.array(kept)],
                                  names=["doc_id", *MEASURES, "base_failed", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(["doc_id long", *(f"{m} long" for m in MEASURES), "base_failed boolean", "kept boolean"]))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that a rule rejects; all columns stay, and no feature is computed for a row that is out.

    Nulls, empty texts and repeated rows as in ``judge``.
    """
    ordered = [rules[i] for i in order_rules(rules, estimate(docs, rules, sample))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            kept, _ = _cascade(Texts(batch.column("text")), ordered, np.ones(batch.num_rows, dtype=bool))
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
