"""Which texts are parts of which others: one walk of each text through an automaton of all possible parts."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of parts in one automaton, and of texts that walk through it in one task. An automaton takes some 100 bytes for
#: a byte of its texts.
PART_BYTES, WHOLE_BYTES = 2 << 20, 8 << 20


def _walk(key: tuple, rows: pa.Table) -> pa.Table:
    """One cell: an automaton of its parts, and the pairs that its other texts find in it. The empty text is part of all."""
    ids, texts, is_part = (rows.column(c).to_pylist() for c in ("id", "text", "is_part"))
    automaton = ahocorasick.Automaton()
    empty = None
    for own, text, part in zip(ids, texts, is_part):
        if part and text:
            automaton.add_word(text, own)
        elif part:
            empty = own
    if len(automaton):
        automaton.make_automaton()
    parts: list[str] = []
    wholes: list[str] = []
    for own, text, part in zip(ids, texts, is_part):
        if not part:
            found = {x for _, x in automaton.iter(text)} if len(automaton) else set()
            if empty is not None:
                found.add(empty)
            parts += found
            wholes += [own] * len(found)
    return pa.table([pa.array(parts, pa.string()), pa.array(wholes, pa.string())], names=["part", "whole"])


def text_size(texts: DataFrame) -> tuple[int, int]:
    """Bytes of all texts, and characters of the longest."""
    return tuple(texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.max(F.length("text")), F.lit(0))).first())


def parts_of(parts: DataFrame, wholes: DataFrame, part_size: tuple[int, int] | None = None, whole_size: tuple[int, int] | None = None) -> DataFrame:
    """``(part, whole)`` hashes (md5) of all pairs where a text of ``parts`` is a substring of a text of ``wholes``.

    Sizes are those of ``text_size``, where the caller has them. Both tables have one column ``text`` of distinct texts without nulls. Parts are dealt to blocks of ``PART_BYTES``, texts to blocks of
    ``WHOLE_BYTES``, and each pair of blocks is a cell of one task: an Aho-Corasick automaton finds
    all parts in one walk over a text, however many begin alike. A row per true pair is all that comes out. Only the
    sizes of the two tables reach the driver. Parts longer than the longest text are left out beforehand.
    """
    total, longest = whole_size or text_size(wholes)
    blocks = max(1, -(-(part_size or text_size(parts))[0] // PART_BYTES))
    parts = parts.where(F.length("text") <= longest)
    chunks = max(1, -(-total // WHOLE_BYTES))

    def dealt(df: DataFrame, is_part: bool) -> DataFrame:
        own, other = ("block", "chunk") if is_part else ("chunk", "block")
        mine, theirs = (blocks, chunks) if is_part else (chunks, blocks)
        return df.select(
            F.pmod(F.xxhash64("text"), F.lit(mine)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(theirs - 1))).alias(other),
            F.md5("text").alias("id"), "text", F.lit(is_part).alias("is_part")).select("block", "chunk", "id", "text", "is_part")

    return dealt(parts, True).union(dealt(wholes, False)).groupBy("block", "chunk").applyInArrow(_walk, "part string, whole string")
