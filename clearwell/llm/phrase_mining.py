"""Collocations by best-first growth: the best phrases of two and three words of each language, and no others, are settled.

A phrase of words that mostly stand together scores ``a * a / (l * r)``: ``a`` its count, ``l`` and ``r`` those of its two parts. Since
``a <= r``, the score is at most ``a / l``, so all phrases that grow from the prefix ``x y`` score at most ``f(x y) / f(x)``: prefix counts
give an admissible bound before anything longer is counted.

Growth goes best first, one frontier at a time. The frontier of a language is a score: words are counted, then pairs, and of the
longer phrases only those whose prefix is bounded by the frontier's score or more, and those around a pair that scores as much
(they decide whether it survives). Every phrase at or above the frontier is then settled. A language is done when as many
survivors as asked for stand there; then no unexpanded prefix can reach the last of them, ties included. Others go on with a lower
frontier, at last with none.

Counting is exact. Where millions of rare pairs would be shuffled as text, their 64-bit hashes are counted first; this only tells
which pairs are worth counting as words. Filters reach the tasks as bit maps of a fixed size, which let too many through, never
too few.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearwell.llm.blocks import BLOCK_BYTES, hash_strings, mixed, signed, stored, text_blocks

UNKNOWN = "und"
#: Bits of a filter's map (16 MB), whatever the number of phrases in it.
MAP_BITS = 1 << 27
#: Hashes that a task counts at once.
HASHES = 4_000_000
#: Pairs above the first frontier of a language for each phrase asked for, and the factor from one frontier to the next.
FIRST, STEP = 2, 4
#: Parts in which a language's phrases are ranked first.
PARTS = 64
_SCALE = 1_000_000

_KIND = np.zeros(256, dtype=np.uint8)  # 0 stands in a word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?\n\x0b\x0c\r"]] = 2
_P = np.random.default_rng(7).integers(1, 2**63, 3, dtype=np.uint64) | np.uint64(1)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StringArray, pa.Array, np.ndarray]]:
    """Lower-cased texts, their languages, and how many first words of each were in the segment before it.

    A text above the block size goes in several segments, each with the last two words of its open piece before it.
    """
    for batch in text_blocks(batches):
        texts = pc.ascii_lower(pc.fill_null(batch.column("text"), ""))
        if batch.num_rows > 1 or pc.binary_length(texts)[0].as_py() <= BLOCK_BYTES:
            yield texts, batch.column("lang"), np.zeros(batch.num_rows, dtype=np.int64)
            continue
        data = texts[0].as_buffer().to_pybytes()
        at, tail = 0, []
        while at < len(data):
            end = min(len(data), at + BLOCK_BYTES)
            if end < len(data):
                open_to = np.flatnonzero(_KIND[np.frombuffer(data, np.uint8, end - at, at)])
                further = re.compile(rb"[\x09-\x0d .,;:!?]").search(data, end)
                end = at + int(open_to[-1]) + 1 if len(open_to) else further.end() if further else len(data)
            part = b"".join(w + b" " for w in tail) + data[at:end]
            yield pa.array([part], pa.binary()).cast(pa.string()), batch.column("lang"), np.array([len(tail)])
            piece = re.split(rb"[.,;:!?\x0a-\x0d]", part)[-1]
            tail = [w for w in re.split(rb"[\x20\x09]+", piece) if w][-2:]
            at = end


class _Block:
    """Words of a block of texts: their codes, what they say, their languages, and which follow one another in a piece."""

    def __init__(self, texts: pa.StringArray, langs: pa.Array, skip: np.ndarray) -> None:
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kind = _KIND[data]
        inside = kind == 0
        first = np.zeros(len(data) + 1, dtype=bool)
        first[offsets] = True
        start = inside & first[:-1]
        start[1:] |= inside[1:] & ~inside[:-1]
        at = np.flatnonzero(start)
        doc = np.searchsorted(offsets, at, side="right") - 1
        piece = np.cumsum(kind == 2, dtype=np.int32)[at]
        self.joined = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
        ends = np.append((np.cumsum(inside, dtype=np.int32) - 1)[at], int(inside.sum())).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[inside]))).dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        own = pc.fill_null(langs, UNKNOWN).dictionary_encode()
        self.langs, self.lang = own.dictionary, own.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
        # an n-gram is counted where its last word is new
        place = np.arange(len(at)) - np.searchsorted(doc, np.arange(len(texts)))[doc]
        self.new = place >= skip[doc]
        self._lang_hash, self._word_hash = hash_strings(self.langs), hash_strings(self.words)

    def runs(self, n: int) -> np.ndarray:
        """First words of the n-grams inside pieces."""
        ok = self.new[n - 1 :].copy()
        for i in range(n - 1):
            ok &= self.joined[i : i + len(ok)]
        return np.flatnonzero(ok)

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        out = self._lang_hash[self.lang[at]]
        for i in range(n):
            out = mixed(out + self._word_hash[self.code[at + i]] * _P[i])
        return out

    def counted(self, at: np.ndarray, n: int) -> pa.RecordBatch:
        """The distinct n-grams that begin ``at``, with their counts in the block."""
        keys = self.lang[at]
        for i in range(n):
            if i > 1:  # keep the products small
                _, keys = np.unique(keys, return_inverse=True)
            keys = keys * len(self.words) + self.code[at + i]
        _, one, times = np.unique(keys, return_index=True, return_counts=True)
        at = at[one]
        return pa.record_batch(
            [self.langs.take(pa.array(self.lang[at])), *(self.words.take(pa.array(self.code[at + i])) for i in range(n)), pa.array(times.astype(np.int64))],
            names=["lang", *(f"w{i + 1}" for i in range(n)), "f"])


class _Map:
    """A set of hashes as a bit map of ``MAP_BITS``."""

    def __init__(self, hashes: DataFrame) -> None:
        bit = F.pmod(F.col("h"), F.lit(MAP_BITS))
        parts = hashes.select(bit.alias("bit")).groupBy(F.expr("bit div 32768").alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("map"))
        filled = np.zeros(MAP_BITS // 8, dtype=np.uint8)
        for r in parts.collect():  # at most as many bits as the map has
            filled[r.bucket * 4096 : (r.bucket + 1) * 4096] = np.frombuffer(r.map, dtype=np.uint8)
        self.sent = hashes.sparkSession.sparkContext.broadcast(filled)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        filled = self.sent.value
        at = signed(hashes) % (8 * len(filled))
        return (filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def drop(self) -> None:
        self.sent.destroy()


def _gram_schema(n: int) -> str:
    return ", ".join(["lang string", *(f"w{i + 1} string" for i in range(n)), "f long"])


def _count(docs: DataFrame, n: int, chosen) -> DataFrame:
    """Counts of the n-grams whose first words ``chosen(block)`` names, over all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs, skip in _segments(batches):
            block = _Block(texts, langs, skip)
            yield block.counted(chosen(block), n)

    names = [f"w{i + 1}" for i in range(n)]
    return docs.mapInArrow(run, _gram_schema(n)).groupBy("lang", *names).agg(F.sum("f").alias("f"))


def _hashed(df: DataFrame, n: int) -> DataFrame:
    """The hashes of a table of n-grams, as blocks compute them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = hash_strings(batch.column(0).cast(pa.string()))
            for i in range(n):
                out = mixed(out + hash_strings(batch.column(i + 1).cast(pa.string())) * _P[i])
            yield pa.record_batch([pa.array(signed(out))], names=["h"])

    return df.select("lang", *(f"w{i + 1}" for i in range(n))).mapInArrow(run, "h long")


def _pair_hashes(docs: DataFrame, frequent: _Map) -> DataFrame:
    """How often each hash of a pair of frequent words occurs, at least."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            h, times = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            return pa.record_batch([pa.array(signed(h)), pa.array(times.astype(np.int64))], names=["h", "f"])

        for texts, langs, skip in _segments(batches):
            block = _Block(texts, langs, skip)
            held.append(block.hashes(_both_frequent(block, frequent), 2))
            if sum(map(len, held)) >= HASHES:
                yield counted()
                held = []
        yield counted()

    return docs.mapInArrow(run, "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))


def _both_frequent(block: _Block, frequent: _Map) -> np.ndarray:
    ok = frequent.has(block.hashes(np.arange(len(block.code)), 1))
    at = block.runs(2)
    return at[ok[at] & ok[at + 1]]


def score(a: str, l: str, r: str) -> Column:
    """floor(1000000 * a * a / (l * r)), in whole numbers of up to 38 digits."""
    top = f"cast({_SCALE} as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))"
    return F.expr(f"({top}) div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)))").cast("long")


def _frontier(scores: DataFrame, wanted: int) -> DataFrame:
    """(lang, theta): the score that ``wanted`` pairs of a language reach, 0 where it has fewer.

    The window runs over distinct scores, of which a language has at most 1,000,001.
    """
    at_score = scores.groupBy("lang", "score").count()
    above = at_score.withColumn("above", F.sum("count").over(Window.partitionBy("lang").orderBy(F.desc("score"))))
    return above.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("above") >= wanted, F.col("score"))), F.lit(0)).alias("theta"))


def _settled(docs: DataFrame, pairs: DataFrame, theta: DataFrame, known: _Map, least: int, inside: int) -> DataFrame:
    """All surviving phrases of the languages in ``theta`` that score their theta or more: (lang, phrase, a, l, r, score)."""
    own = stored(pairs.join(theta, "lang"), "frontier")
    high = own.where("score >= theta")
    bounded = F.expr(f"cast({_SCALE} as decimal(7,0)) * cast(a as decimal(15,0)) >= cast(theta as decimal(7,0)) * cast(l as decimal(15,0))")
    grow, near = _Map(_hashed(own.where(bounded), 2)), _Map(_hashed(high, 2))

    def chosen(block: _Block) -> np.ndarray:
        at = block.runs(3)
        first, second = block.hashes(at, 2), block.hashes(at + 1, 2)
        return at[known.has(first) & known.has(second) & (grow.has(first) | near.has(second))]

    threes = stored(_count(docs, 3, chosen).where(F.col("f") >= least).withColumnRenamed("f", "a"), "threes")
    grow.drop()
    near.drop()
    head = own.select("lang", "w1", "w2", F.col("a").alias("l2"), F.col("l").alias("l1"), "theta")
    rest = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    cut = threes.join(head, ["lang", "w1", "w2"]).join(rest, ["lang", "w2", "w3"])
    cut = cut.withColumn("s1", score("a", "l1", "r1")).withColumn("s2", score("a", "l2", "r2")).withColumn("second", F.col("s2") < F.col("s1"))
    pick = lambda one, two: F.when(F.col("second"), F.col(two)).otherwise(F.col(one))
    cut = cut.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"), "theta")
    longer = threes.select("lang", "a", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    longer = longer.groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longest"))
    twos = high.join(longer, ["lang", "w1", "w2"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < inside * F.col("a")))
    twos = twos.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", "score")
    return twos.union(cut.where("score >= theta").drop("theta"))


def mine_phrases(docs: DataFrame, limit: int = 2000, least: int = 10, inside: int = 50) -> DataFrame:
    """``docs`` (text, lang, ...) to (lang, rank, phrase, a, l, r, n, score): each language's best phrases of two or three words.

    Texts with A-Z in lower case fall into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs. Candidates
    occur ``least`` times or more. The cut of a candidate with the lowest score counts (ties: the first); ``l`` and ``r`` are its
    parts' counts. A candidate inside a longer one that has ``inside`` per cent of its occurrences or more is dropped. Ranks go by
    score, then count (both descending), then phrase in byte order; ``n`` is the language's number of words.

    A null lang is ``und``, null and empty texts have no words, texts of any length are read in segments. Repeated rows count as
    often as they stand there; other columns are ignored; an empty table gives an empty result. Counts may reach 10^15.
    Jobs run when this is called; the input is read four times or more and must return the same rows each time.
    """
    docs = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    words = stored(_count(docs, 1, lambda block: block.runs(1)), "words")
    sizes = stored(words.groupBy("lang").agg(F.sum("f").alias("n")), "word-totals")
    words = words.where(F.col("f") >= least)
    frequent = _Map(_hashed(words, 1))
    known = _Map(stored(_pair_hashes(docs, frequent).where(F.col("f") >= least).select("h"), "pair-hashes"))

    def chosen(block: _Block) -> np.ndarray:
        at = _both_frequent(block, frequent)
        return at[known.has(block.hashes(at, 2))]

    pairs = _count(docs, 2, chosen).where(F.col("f") >= least).withColumnRenamed("f", "a")
    pairs = pairs.join(words.select("lang", "w1", F.col("f").alias("l")), ["lang", "w1"])
    pairs = pairs.join(words.select("lang", F.col("w1").alias("w2"), F.col("f").alias("r")), ["lang", "w2"])
    pairs = stored(pairs.select("lang", "w1", "w2", "a", "l", "r", score("a", "l", "r").alias("score")), "pairs")
    frequent.drop()

    wanted, todo, done = FIRST * limit, pairs, []
    while not todo.isEmpty():
        theta = stored(_frontier(todo, wanted), "frontiers")
        found = stored(_settled(docs, pairs, theta, known, least, inside), "settled")
        kept = found.groupBy("lang").count().where(F.col("count") >= limit)
        ended = stored(theta.join(kept, "lang", "left").where("theta = 0 or count is not null").select("lang"), "ended")
        done.append(found.join(ended, "lang", "left_semi"))
        todo = stored(todo.join(ended, "lang", "left_anti"), "open")
        wanted *= STEP
    known.drop()
    best = done[0] if done else pairs.select("lang", F.lit("").alias("phrase"), "a", "l", "r", "score")
    for more in done[1:]:
        best = best.union(more)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # ranks within parts first: a language sends the best of each part to the task that ranks them all
    part = Window.partitionBy("lang", "part").orderBy(*order)
    best = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= limit)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= limit)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
