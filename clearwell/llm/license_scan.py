"""License scans by template matching: license notices as marked-up templates, compiled to automata over words.

A template is text with optional regions ``<<optional>> ... <<end>>`` and replaceable regions ``<<var:N>>``, which stand
for up to N words. It compiles to an automaton whose states are places in the template; a text is accepted where the
automaton runs from some word to its last state, so all mandatory words stand there exactly and in order, whatever
is chosen for the marked regions. White space, punctuation and the case of A-Z never count. A template is tried on those
texts only that hold its anchor, one of its mandatory words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearwell.llm.blocks import text_blocks

#: What a word is, on text with A-Z in lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and the labels they give.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label, anchor (a mandatory word), marked-up notice
TEMPLATES = (
    ("apache-2.0", "apache", "licensed under the <<optional>>terms of the<<end>> apache license <<optional>>version<<end>> 2.0"),
    ("mit", "license", "<<optional>>released under the<<end>> mit license"),
    ("mit", "sublicense", "permission is hereby granted free of charge to any person obtaining a copy of this <<var:6>> to deal in the "
     "<<var:4>> without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met"),
    ("isc", "permission", "permission to use copy modify and or distribute this <<var:3>> for any purpose with or without fee is hereby granted"),
    ("gpl-3.0", "gnu", "<<optional>>licensed under the<<end>> gnu general public license <<optional>>as published by the free software "
     "foundation<<end>> <<optional>>either<<end>> version 3"),
    ("gpl-2.0", "gnu", "<<optional>>licensed under the<<end>> gnu general public license <<optional>>as published by the free software "
     "foundation<<end>> <<optional>>either<<end>> version 2"),
    ("lgpl", "lesser", "gnu lesser general public license"),
    ("mpl-2.0", "mozilla", "subject to the terms of the mozilla public license <<optional>>v<<end>> <<optional>>version<<end>> 2.0"),
    ("cc-by-nc", "nc", "cc by nc <<optional>>4.0<<end>>"),
    ("cc-by-sa", "sa", "cc by sa <<optional>>4.0<<end>>"),
    ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial"),
    ("copyright", "copyright", "copyright <<optional>>c<<end>> <<var:8>> all rights reserved"),
    ("proprietary", "permission", "may not be <<var:6>> without <<optional>>the<<end>> <<optional>>prior<<end>> written permission"),
)


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(_LOWER))


_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Automaton:
    """From state i: ``word[i]`` leads to i + 1; ``skip[i]`` are states reached without a word; ``free[i]`` takes any word."""

    label: str
    anchor: str
    word: tuple[str | None, ...]
    skip: tuple[tuple[int, ...], ...]
    free: tuple[bool, ...]
    mandatory: int
    base: bool

    def spread(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for j in self.skip[todo.pop()]:
                if j not in states:
                    states.add(j)
                    todo.append(j)
        return states

    def firsts(self) -> set[str] | None:
        """Words that a match can begin with; None if it can be any."""
        states = self.spread({0})
        return None if any(self.free[i] for i in states) else {self.word[i] for i in states if self.word[i]}

    def match(self, words: list[str], start: int) -> int | None:
        """Where the longest match from ``start`` ends, if there is one."""
        states, last, end = self.spread({0}), len(self.word) - 1, None
        for at in range(start, len(words) + 1):
            if last in states:
                end = at
            if at == len(words) or not states:
                break
            w = words[at]
            states = self.spread({i + 1 for i in states if self.free[i] or self.word[i] == w})
        return end


def compile_template(label: str, anchor: str, markup: str, base: bool = False) -> Automaton:
    """Regions do not nest. The template must have a mandatory word at its end and its anchor among its mandatory words."""
    word: list[str | None] = []
    skip: list[list[int]] = []
    free: list[bool] = []
    opened: int | None = None
    mandatory: list[str] = []

    def state(w: str | None = None, any_word: bool = False) -> None:
        word.append(w)
        skip.append([])
        free.append(any_word)

    for part in re.findall(r"<<[^>]*>>|[^<]+", markup):
        if part == "<<optional>>":
            opened = len(word)
            state()
            skip[-1].append(len(word))
        elif part == "<<end>>":
            skip[opened].append(len(word))
            opened = None
        elif part.startswith("<<var:"):
            n = int(part[6:-2])
            for i in range(n):
                state(any_word=True)
                skip[-1].append(len(word) + n - 1 - i)
        else:
            for w in words_of(part):
                state(w)
                if opened is None:
                    mandatory.append(w)
    state()
    if anchor not in mandatory:
        raise ValueError(f"the anchor {anchor!r} must be a mandatory word")
    return Automaton(label, anchor, tuple(word), tuple(map(tuple, skip)), tuple(free), len(mandatory), base)


@lru_cache(maxsize=4)
def automata(templates: tuple = TEMPLATES) -> tuple[Automaton, ...]:
    base = tuple(compile_template(label, max(phrase.split(), key=len), phrase, True) for phrase, label in BASE_PHRASES.items())
    return base + tuple(compile_template(*t) for t in templates)


def matches(words: list[str], machines: tuple[Automaton, ...]) -> list[tuple[int, int, Automaton]]:
    """All places (first word, end, automaton) where a template is accepted."""
    out = []
    held = set(words)
    for machine in machines:
        if machine.anchor in held:
            firsts = machine.firsts()
            for i, w in enumerate(words):
                if (firsts is None or w in firsts) and (end := machine.match(words, i)) is not None:
                    out.append((i, end, machine))
    return out


def scan_licenses(df: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """``df`` (doc_id, text, ...) to (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places).

    ``places`` lists (label, start, end) in words for every accepted template. ``n_base``, ``first_word`` and ``last_word``
    count the places of the fixed phrases alone. ``score`` is m / (m + 3) for the most mandatory words m of an
    accepted template, 0 without one. Null and empty texts have no words and no label; repeated rows give repeated
    rows; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = automata(templates)
        anchors = "|".join(sorted({re.escape(m.anchor) for m in machines}))
        for batch in text_blocks(batches):
            low = pc.ascii_lower(pc.fill_null(batch.column("text"), ""))
            count = pc.count_substring_regex(low, WORD)
            maybe = pc.match_substring_regex(low, f"(?:^|[^a-z0-9])(?:{anchors})").to_pylist()
            rows = []
            for text, hit in zip(low, maybe):
                found = matches(re.findall(WORD, text.as_py()), machines) if hit else []
                base = [i for i, _, m in found if m.base]
                rows.append((
                    len(base), min(base, default=None), max(base, default=None),
                    ",".join(sorted({m.label for _, _, m in found if m.base})), ",".join(sorted({m.label for _, _, m in found})),
                    max((m.mandatory / (m.mandatory + 3) for _, _, m in found), default=0.0),
                    [{"label": m.label, "start": i, "end": e} for i, e, m in sorted(found, key=lambda x: (x[0], x[1], x[2].label))]))
            cols = list(zip(*rows))
            yield pa.record_batch(
                [batch.column("doc_id"), count.cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"])

    place = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(place))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, places array<struct<label: string, start: long, end: long>>")


def template_regex(markup: str) -> str:
    """The same template for an engine with regular expressions, over words that are each followed by one blank."""
    out = []
    for part in re.findall(r"<<[^>]*>>|[^<]+", markup):
        if part == "<<optional>>":
            out.append("(?:")
        elif part == "<<end>>":
            out.append(")?")
        elif part.startswith("<<var:"):
            out.append(f"(?:[^ ]+ ){{0,{part[6:-2]}}}")
        else:
            out += [f"{w} " for w in words_of(part)]
    return "".join(out)
